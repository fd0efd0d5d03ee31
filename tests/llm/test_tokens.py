import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from routecast.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OURS = tokens.Transducer(PATH)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "ing", " ", "   ", "\n", "é", "漢", "🙂", "er", "tion", "12", ".", "▁", "x" * 5, "\x00"]), max_size=20))
def test_against_the_library(parts):
    text = "".join(parts)
    assert OURS.encode(text) == LIBRARY.encode(text)
    assert OURS.decode(OURS.encode(text)) == LIBRARY.decode(LIBRARY.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    back = OURS.decode(OURS.encode(text))
    assert back == text.replace("▁", " ")


def test_documents(documents):
    got = {r.doc_id: r for r in tokens.op8_sentencepiece(documents).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = LIBRARY.encode(r.text)
        g = got[r.doc_id]
        assert (g.n_pieces, g.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert g.same and g.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_odd_rows(make_docs, odd_rows):
    from pyspark.sql import functions as F

    df = make_docs(odd_rows).withColumn("ids", F.lit(1)).withColumn("same", F.lit(1))
    got = tokens.encode(df, PATH).collect()
    assert len(got) == len(odd_rows)
    assert all((r.ids is None) == (r.same is None) for r in got)
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(LIBRARY.encode(t) if t is not None else None) for _, t in odd_rows)
    assert tokens.op8_sentencepiece(df.limit(0)).count() == 0


def test_unigram_shortest_path(tmp_path):
    """A hand-made unigram file: the path with the best sum of scores, not the greedy one."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    m = format_.ModelProto()
    for piece, score, kind in (("<unk>", 0, 2), ("ab", -3, 1), ("abc", -1.5, 1), ("cd", -1, 1), ("a", -5, 1), ("b", -5, 1), ("c", -5, 1), ("d", -5, 1), ("▁", -1, 1)):
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type = 1
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    path = tmp_path / "u.model"
    path.write_bytes(m.SerializeToString())
    t = tokens.Transducer(str(path))
    assert [t.pieces[i] for i in t.encode("abcd")] == ["▁", "ab", "cd"]
    assert t.encode("z")[-1] == 0


def test_a_broken_character_map_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as format_

    m = format_.ModelProto()
    m.normalizer_spec.precompiled_charsmap = b"x"
    (tmp_path / "n.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        tokens.Transducer(str(tmp_path / "n.model"))


ODD = ["a", "B", "ab", " ", "  ", "\t", "\n", "\u3000", "\uff71", "\uff9e", "\u2460", "e\u0301", "\ufb01", "\u200b", "\u00a0", "\u2581", "\u0130", "\u6f22", "\u1112\u1161\u11ab", "\U0001f642", "\x01", "\u337f"]


def _model(path, rule, kind=1, fallback=True, **flags):
    """A hand-made file with the library's own character map of `rule`."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    m = format_.ModelProto()
    m.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    for name, on in flags.items():
        setattr(m.normalizer_spec, name, on)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, fallback
    del m.pieces[:]
    for piece, score, k in (("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)):
        m.pieces.add(piece=piece, score=score, type=k)
    for b in range(256 * fallback):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for i, piece in enumerate(["\u2581", "a", "b", "ab", "\u2581a", "\u2581ab", "fi", "f", "i", "aa", "aab", "\u30a2", "\u00e9", "ba", "\u2581b", "b\u2581"][:15 if kind == 2 else 16]):
        m.pieces.add(piece=piece, score=-float(i) if kind == 2 else -math.sqrt(2 + i), type=1)
    path.write_bytes(m.SerializeToString())
    return str(path)


FLAGS = ["add_dummy_prefix", "escape_whitespaces", "remove_extra_whitespaces"]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normaliser_against_the_library(tmp_path, rule):
    for values in itertools.product([False, True], repeat=3):
        flags = dict(zip(FLAGS, values))
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
        ours = tokens.Transducer(_model(tmp_path / "n.model", rule, **flags))

        @settings(max_examples=60, deadline=None, database=None)
        @given(st.one_of(st.text(max_size=12), st.lists(st.sampled_from(ODD), max_size=9).map("".join)))
        def check(text):
            want = library.Normalize(text)
            assert ours.normalise(text) == (want.replace(tokens.MARK, " ") if flags["escape_whitespaces"] else want)

        check()


@pytest.mark.parametrize("kind,fallback,squeeze", list(itertools.product([1, 2], [False, True], [False, True])))
def test_mapped_files_against_the_library(tmp_path, kind, fallback, squeeze):
    """Unigram and merge files with a character map, with byte fallback or unknown ids, encoded and decoded as the library does."""
    path = _model(tmp_path / "m.model", "nmt_nfkc", kind, fallback, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Transducer(path)

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.one_of(st.text(max_size=12), st.lists(st.sampled_from(ODD), max_size=12).map("".join)))
    def check(text):
        ids = library.encode(text)
        assert ours.encode(text) == ids
        assert ours.decode(ids) == ours.text_of(np.array(ids, "<u4").tobytes()) == library.decode(ids)

    check()


def test_fallback_reads_whole_characters():
    """Every path through the four states gives the bytes of one character."""
    for c in ("\x00", "\x7f", "\x80", "\u07ff", "\u0800", "\uffff", "\U00010000", "\U0010ffff"):
        _, packed, _ = OURS._fallback(c)
        assert bytes(OURS.of_byte[i] for i in np.frombuffer(packed, "<u4").tolist()) == c.encode()


def test_broken_maps_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as format_

    m = format_.ModelProto()
    m.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())
    whole = m.normalizer_spec.precompiled_charsmap
    assert dict(tokens.character_map(whole))["\ufb01"] == "fi"
    for blob in (b"x", whole[:3], whole[:1000], b"\x05\x00\x00\x00" + whole[4:]):
        with pytest.raises(ValueError):
            list(tokens.character_map(blob))
