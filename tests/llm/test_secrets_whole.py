import pytest

from routecast.llm import secrets

SECRET = "Ab12Cd34Ef56"
TEXTS = [
    'see https://x.org/docs then set client_pwd = "Ab12Cd34Ef56"', "#news today, db_pwd = Ab12Cd34Ef56", '// client_pwd := "Ab12Cd34Ef56"',
    "x = 1  # db_pwd = Ab12Cd34Ef56", "db_pwd = Ab12Cd34Ef56 # old", "# db_pwd = 'Ab12Cd34Ef56'", "https://x.org/a?client_pwd=Ab12Cd34Ef56", "https://x.org/client_pwd=Ab12Cd34Ef56",
    "don't use db_pwd = Ab12Cd34Ef56 it's old", "a, 'tis client_pwd = 'Ab12Cd34Ef56' ok", "so, 'twas db_pwd = Ab12Cd34Ef56 isn't", "note: 'set db_pwd = Ab12Cd34Ef56 now'",
    'run("export DB_PWD=Ab12Cd34Ef56")', 'set "client_pwd" = "Ab12Cd34Ef56"', 'the "client pwd!": "Ab12Cd34Ef56"',
    "pwd2_pwd-1 = Ab12Cd34Ef56", "db_pwd_2 = Ab12Cd34Ef56", "db.pwd. := 'Ab12Cd34Ef56'", "pwd$ = Ab12Cd34Ef56", "pwd- = Ab12Cd34Ef56", "--client-pwd=Ab12Cd34Ef56", '"client pwd!" = "Ab12Cd34Ef56"', "x: /a/client_pwd=Ab12Cd34Ef56",
]


def found(text):
    return [text[s:e] for s, k, e in secrets.spans_of(text) if k == 3]


@pytest.mark.parametrize("text", TEXTS)
def test_whole_text_is_lexed(text):
    assert SECRET in found(text)


def test_values_still_end_where_they_did():
    assert found("db_pwd = # Ab12Cd34Ef56") == []
    assert found("db_pwd = 9Ab=Cd34Ef56") == ["9Ab=Cd34Ef56"]
    assert found("1=" * 20_000) == []


def test_prefilter_lets_all_through(make_docs):
    texts = [*TEXTS, "db_pwd = $Ab12Cd34Ef56", "db_pwd = .Ab12Cd34Ef56", "db_pwd = -Ab12Cd34Ef56"]
    got = {r.doc_id: r.spans for r in secrets.op9_secrets(make_docs(list(enumerate(texts)))).collect()}
    assert [t for i, t in enumerate(texts) if "literal" not in got[i]] == ["db_pwd = $Ab12Cd34Ef56"]  # `$x` is a placeholder
    hidden = [r.text for r in secrets.redact(make_docs(list(enumerate(TEXTS)))).collect()]
    assert not [t for t in hidden if SECRET in t]
