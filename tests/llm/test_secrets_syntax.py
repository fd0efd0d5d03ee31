import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routecast.llm import secrets

from .test_secrets_whole import found

FORMS = [
    'os.environ["DB_PWD"] = "Ab12Cd34Ef56"', "cfg['db']['pwd'] = 'Ab12Cd34Ef56'", 'self.client_pwd: str = "Ab12Cd34Ef56"', 'pwd: Optional[str] = "Ab12Cd34Ef56"', 'db_pwd = b"Ab12Cd34Ef56"',
    "db_pwd = rb'Ab12Cd34Ef56'", 'db_pwd = """Ab12Cd34Ef56"""', "db_pwd = '''Ab12Cd34Ef56'''", "db.pwd := `Ab12Cd34Ef56`", 'K = "Ab12Cd34Ef56"\ndb_pwd = (K)', 'const pwd = Buffer.from("Ab12Cd34Ef56")',
    'var pwd string = "Ab12Cd34Ef56"', "let pwd: &'static str = \"Ab12Cd34Ef56\";", 'pwd = new Secret("Ab12Cd34Ef56")', 'run(pwd="Ab12Cd34Ef56", n=1)',
]


@pytest.mark.parametrize("text", FORMS)
def test_forms(text):
    assert found(text) == ["Ab12Cd34Ef56"]
    assert found(f"x = 1\n{text}\ny = 'z'\n") == ["Ab12Cd34Ef56"]


def test_joins_within_parentheses():
    assert found('db_pwd = ("Ab12" + ("Cd34Ef56"))') == ["Ab12", "Cd34Ef56"]


@pytest.mark.parametrize("text", ['pwd = os.getenv("DB_PASSWORD_7a")', "pwd = config.password", 'pwd = vault.decrypt("client_secret")', "pwd = get_password()", 'pwd: str\nname = "Ab12Cd34Ef56"'])
def test_references_are_no_literals(text):
    assert found(text) == []


def test_open_quotes_hide_nothing():
    assert found('x = """ never closed\ndb_pwd = "Ab12Cd34Ef56"') == ["Ab12Cd34Ef56"]
    assert found('x = ` never closed\ndb_pwd = "Ab12Cd34Ef56"') == ["Ab12Cd34Ef56"]
    assert found('x = """ a\ndb_pwd = "Ab12Cd34Ef56"\n"""') == ["Ab12Cd34Ef56"]


GROWING = {
    "doublings": lambda n: 'a = "bbbbbbbb1"\n' + "a = a + a\n" * (n // 10) + 'db_secret = a + "c"', "escapes": lambda n: 'x_pwd = "' + '\\"y' * (n // 3), "closed escapes": lambda n: 'x_pwd "' + '\\"y' * (n // 3) + '"',
    "triple": lambda n: "pwd = " + '"""a ' * (n // 5), "back": lambda n: "pwd = `" + " = `" * (n // 4), "chain": lambda n: 'a = "Zx81"\n' + 'a = a + "-hunter"\n' * (n // 18) + "db_pwd=a",
    "own": lambda n: 'db_pwd = db_pwd + "q8X"\n' * (n // 24), "parentheses": lambda n: "db_pwd = " + "(" * n, "types": lambda n: "pwd:a" * (n // 5), "type": lambda n: "pwd: " + "a " * (n // 2),
}


@pytest.mark.parametrize("kind", GROWING)
def test_time_grows_with_the_text(kind):
    took = []
    for n in (125_000, 1_000_000):
        text = GROWING[kind](n)
        began = time.process_time()
        secrets.spans_of(text)
        took.append(time.process_time() - began)
    assert took[1] < 20 * max(took[0], 0.1)


PIECES = ["pwd", "secret", "K", "=", ":", ":=", "+", "(", ")", "[", "]", '"', "'", "`", '"""', "\\", "\n", " ", ",", "b", "var", "str", "new", ".get", "Ab12Cd34Ef56", "é", "#", "//", "{", "a = a + a\n"]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join))
def test_no_text_raises(text):
    for s, k, e in secrets.spans_of(text):
        assert 0 <= s < e <= len(text)


def test_long_constants_keep_their_score(make_docs):
    """A constant of 2^1100 characters is scored like a short one of the same shares."""
    text = 'a = "q8Xz72LmPw"\n' + "a = a + a\n" * 1100 + "db_secret = a\n"
    assert found(text) == ["q8Xz72LmPw"]
    rows = secrets.op9_secrets(make_docs([(1, text), (2, 'a = "bbbbbbbb1"\n' + "a = a + a\n" * 1100 + 'db_secret = a + "c"')])).collect()
    assert {r.doc_id: r.spans for r in rows} == {1: f"literal:5:15", 2: ""}
