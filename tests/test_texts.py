"""Text rules and readers against plain Python."""

import re

import numpy as np

from routecast.functions import expr as X
from routecast.sources import records as R
from pyspark.sql import functions as F


def math_loop(text):
    """Pairs of single dollars from the left; whether a pair changes is decided after it is paired."""
    text = re.sub(r"\$\$(.+?)\$\$", lambda m: "\\[" + m[1] + "\\]", text, flags=re.S)

    def one(m):
        inside = m[1].strip()
        return "\\(" + m[1] + "\\)" if inside and (not inside[0].isdigit() or re.search(r"[\\^_=]", inside)) else m[0]

    return re.sub(r"(?<!\$)\$(?!\$)([^$\n]+?)\$(?!\$)", one, text)


def test_dollars_pair_from_the_left(spark):
    r = np.random.default_rng(3)
    pieces = ["$", "$$", "5", "x", " ", "\n", "^", "\\", "_", " and ", "é", "=", "$5", "x$"]
    texts = ["".join(pieces[int(i)] for i in r.integers(0, len(pieces), int(r.integers(0, 14)))) for _ in range(1500)] + ["$5 and $x$", "pay $5 and $10, $x$", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [x.m for x in df.select("i", X.math_delimiters(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [math_loop(t) for t in texts]
    assert got[1500] == "$5 and $x$"


def test_participants_of_files_with_a_mark(spark, tmp_path):
    (tmp_path / "P1.csv").write_bytes("﻿participant_id,prompt_id\nP1,1\nP1,2\nP2,3\n".encode())
    (tmp_path / "P 2.csv").write_bytes(b"participant_id,prompt_id\nP 2,1\nP 2,1\n")
    df = R.read_participants(spark, str(tmp_path), "participant_id string, prompt_id long")
    got = sorted((tuple(x) for x in R.participant_faults(df).collect()), key=str)
    assert got == [("P 2", 1, "P 2", "repeated")] * 2 + [("P1", 1, "P1", None), ("P1", 2, "P1", None), ("P2", 3, "P1", "participant")]


def test_last_line_of_a_key_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1, "v": 1}\n{"k": 2, "v": 2}\n{"k": 1, "v": 3}\nnot json\n{"v": 9}\n')
    (tmp_path / "b.json").write_text('{"k": 2, "v": 4}\n{"k": 1, "v": \n\n')
    assert sorted(map(tuple, R.read_latest(spark, str(tmp_path), "k long, v long", "k").collect())) == [(1, 3), (2, 4)]
