import textwrap

import duckdb

from somalog.llm import license_scan
from somalog.llm.license_texts import KNOWN


def test_variants_of_one_text_match(spark):
    mit = next(t for name, t in KNOWN if name == "MIT" and t.startswith("Permission"))
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit),
        (2, "/* copyright 1999 x */\n".replace("/* ", "* ") + mit.upper().replace("\n", "\r\n  ")),
        (3, mit.replace("sublicense", "sub-license").replace('"', "")),
        (4, mit.replace("software", "softwares", 1)),
        (5, "words\n  released under the MIT Licence\nLicensed under CC BY-NC 4.0.\nlicensed under cc by nc 4 0\nmore"),
        (6, None),
        (7, ""),
        (None, "Released under the MIT License."),
        (5, "words\n  released under the MIT Licence\nLicensed under CC BY-NC 4.0.\nlicensed under cc by nc 4 0\nmore"),
    ]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, license_id string, key int").repartition(3)
    got = {(r.doc_id, r.license_id, r.n_notices, r.notices) for r in license_scan.scan(docs).collect()}
    assert got == {(1, "MIT", 0, None), (2, "MIT", 0, None), (3, "MIT", 0, None), (4, None, 0, None), (5, None, 3, "CC-BY-NC-4.0,MIT"), (6, None, 0, None), (7, None, 0, None), (None, "MIT", 1, "MIT")}
    assert license_scan.scan(docs).count() == len(rows)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_known_texts_differ_and_find_themselves(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(KNOWN)], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in license_scan.scan(docs).collect()} == dict(enumerate(name for name, _ in KNOWN))


def test_spellings_keep_beginnings():
    for other, kept in license_scan.SPELLINGS:
        assert other[:3] == kept[:3] and " " not in other[:3]


def test_known_texts_match_at_any_line_width(spark):
    wrap = lambda t, width: "\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in t.split("\n"))
    rows = [(name, "Copyright (c) 2020 Some One\n\n" + wrap(t, width)) for name, t in KNOWN for width in range(12, 101)]
    assert any("\ncopyright notice" in t for _, t in rows) and any("\nCOPYRIGHT HOLDER" in t for _, t in rows)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(4)
    wrong = [rows[r.doc_id] for r in license_scan.scan(docs).collect() if r.license_id != rows[r.doc_id][0]]
    assert not wrong


def test_lines_that_claim_copyright(spark):
    mit = next(t for name, t in KNOWN if name == "MIT" and t.startswith("Permission"))
    claims = ["Copyright 2019, 2020 A", "copyright by A", "# Copyright (C) A", "Copyright © A", "Copyright The A Authors", "(c) 2020 A", "(c) Copyright A", "© A", "All rights reserved.", "Copyright: 2020 A"]
    others = ["copyright notice", "Copyright holders of this", "(c) you must retain it", "copyright law", "copyright"]
    docs = spark.createDataFrame([(i, f"{line}\n{mit}") for i, line in enumerate(claims + others)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license_scan.scan(docs).collect()}
    assert got == {i: "MIT" if i < len(claims) else None for i in range(len(claims + others))}


def test_known_texts_from_a_table_and_a_folder(spark, tmp_path):
    long = "Some Licence\n\n" + " ".join(f"Clause {i} says that one may honour it." for i in range(900))
    (tmp_path / "Some-1.0.txt").write_text("Copyright (c) 2001 A. Body\n" + long)
    (tmp_path / "Short-2").write_text("One line licence.\n")
    docs = spark.createDataFrame([(1, long.upper().replace("HONOUR", "HONOR")), (2, "x\nONE line licence\ny"), (3, None)], "doc_id long, text string")
    for known in (license_scan.from_folder(spark, str(tmp_path)), spark.createDataFrame([("Some-1.0", long), ("Short-2", "one line license"), ("None", None)], "license_id string, text string")):
        got = {r.doc_id: (r.license_id, r.n_notices, r.notices) for r in license_scan.scan(docs, known).collect()}
        assert got == {1: ("Some-1.0", 0, None), 2: (None, 1, "Short-2"), 3: (None, 0, None)}


def test_sql_agrees_on_wrapped_and_claiming_lines(spark):
    wrap = lambda t, width: "\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in t.split("\n"))
    lines = ["Copyright", "copyright \t", "Copyright notices are kept", "copyright owner x", "Copyright Acme", "copyrighted", "(c) keep this", "(c) 2001 me", "(C) Copyright", "# (c) you. All rights reserved", "\u00a9 x", "all rights reserved.", "copyright andes", "copyright and", "Copyright\r", "text (c) 2001", "copyright of 2001", " * Copyright 1999\r"]
    mit = next(t for name, t in KNOWN if name == "MIT" and t.startswith("Permission"))
    rows = [wrap(t, width) for _, t in KNOWN for width in (20, 33, 72)] + [f"{line}\n{mit}" for line in lines] + ["\n".join(lines), None, ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = license_scan.scan(docs)
    base = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841  read by the SQL
    base.sql("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents")
    want = base.sql(f"SELECT {', '.join(got.columns)} FROM ({license_scan.oracle_sql()})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda r: r[0])
