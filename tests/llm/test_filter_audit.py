import re
from itertools import permutations

import duckdb
import pytest

from somalog.llm import filter_audit

LETTERS = "ABCDE"
SCHEMA = "doc_id long, text string, lang string, mask string, n int"
LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    """(part, set of failed letters, doc_id) of (doc_id, text, lang)."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search(r"[#$%&*|]", text), i is not None and i > least[text])
        yield lang or "", {x for x, t in zip(LETTERS, tests, strict=True) if t}, i


def plain(rows, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    docs, out = list(failures(rows)), set()
    for part in {p for p, _, _ in docs}:
        own, shares, found = [(f, i) for p, f, i in docs if p == part], dict.fromkeys(LETTERS, 0), []
        for order in permutations(LETTERS):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [d for d in left if x in d[0]], [d for d in left if x not in d[0]]
                shares[x] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), sum(x in f for f, _ in own) - len(gone), sum(f == {x} for f, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)))
        out |= {(*r, shares[r[1][r[2] - 1]]) for r in found}
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))


def test_against_plain_filters(spark):
    long = " ".join(f"word{i}" for i in range(250))
    texts = [long, "a b c", None, "", "SHOUT", "x #", f"{long} $", "z " * 300, f"{long.upper()}", "é𝒳 " * 210, "w" * 100_000, " \t\n", "a b c"]
    rows = [(i, texts[i % len(texts)], ("en", "de", None, "")[i % 4]) for i in range(130)]
    rows += [(None, long, "en"), (None, long, "en"), (3, texts[3], "de"), (3, texts[3], "en"), (0, "other text of the same id", "en"), (0, long, "en")]
    labels = [(i, i % 2, i % 3) for i in range(0, 130, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    got = audited(spark, rows, labels)
    assert {tuple(r) for r in got.collect()} == plain(rows, labels) and got.count() == 3 * 600


def test_empty_tables(spark):
    assert audited(spark, [], []).count() == 0
    assert {tuple(r) for r in audited(spark, [(1, None, None)], []).collect()} == plain([(1, None, None)], [])


def test_whole_table_and_sql(spark):
    from somalog.llm import queries

    folder = "/root/testdata/sf0.001"
    got = queries.op12_filter_interactions(spark, folder)
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    rows = {tuple(r) for r in got.collect()}
    assert rows == plain(docs, labels)
    base = duckdb.connect()
    for t in ("documents", "labels"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert set(base.sql(f"SELECT {', '.join(got.columns)} FROM ({filter_audit.ORACLE_SQL})").fetchall()) == rows


@pytest.mark.parametrize("n", range(1, 6))
def test_plain_changes_visit_all_orders(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in filter_audit.plain_changes(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(permutations(range(n))))


def test_swaps_keep_the_diagram_reduced():
    counts = {m: (m % 5, m % 2) for m in range(32) if m % 3}
    diagram = filter_audit.Diagram(counts, 5)
    for k in filter_audit.plain_changes(5):
        diagram.swap(k)
        place = {f: i for i, f in enumerate(diagram.order)}
        again = filter_audit.Diagram({sum(1 << place[i] for i in range(5) if m >> i & 1): c for m, c in counts.items()}, 5)
        assert [len(x) for x in diagram.levels] == [len(x) for x in again.levels]
        assert diagram.weight[diagram.root] == again.weight[again.root]
