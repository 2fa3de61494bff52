"""Rule cascade: statistics by brute force, verdicts independent of the order."""

import itertools
import re
from collections import Counter

import pyarrow.parquet as pq

from quarry.llm import quality_rules as Q

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count, covered = Counter(wins), set()
    for i, x in enumerate(wins):
        if count[x] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    n = len(w)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_words int")
    got = Q.quality_report(df).collect()
    stats = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    assert Counter(stats) == Counter((i, *brute(t)) for i, t in rows)
    assert all(r.kept == (r.rejected_by is None) and not (r.kept and r.base_failed) for r in got)
    return {r.doc_id: r for r in got}


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    check(spark, list(zip(t["doc_id"], t["text"])))


def test_edges(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    line = "a line of eight words or more here\n"
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, prose), (5, line * 40), (6, "x " * 5000), (7, prose + "\n" + prose),
            (8, "a b c d e f g h a b c d e f g h"), (9, "w " * 7), (10, " ".join(f"###{i}" for i in range(50))),
            (11, prose.upper()), (12, " ".join(f"a{i}!!" for i in range(40))), (13, "\n".join(["one two"] * 3) + "\n" + prose),
            (14, " ".join(str(i) for i in range(1000, 1100))), (15, "é" * 40 + " " + prose), (4, prose),
            (16, " ".join(f"word{i // 4}x" for i in range(80))), (None, " ".join(f"v{i % 3000}" for i in range(30_000)))]
    got = check(spark, rows)
    assert got[4].kept and got[15].kept and not any(got[k].kept for k in (10, 11, 12, 14, 16))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = {r.name: {x.doc_id for x in df.where(r.rejects(Q.whole("text"))).collect()} for r in Q.standard_rules()}
    assert 10 in rules["symbols"] and 11 in rules["capitals"] and 12 in rules["exclamations"]
    assert 14 in rules["letters"] and 16 in rules["stutter"] and 5 in rules["repeated_lines"]
    assert not any(4 in found for found in rules.values())


def test_order_never_changes_the_verdict(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    df = spark.createDataFrame(list(zip(t["doc_id"], t["text"])), "doc_id long, text string")
    rules = Q.standard_rules()
    col = Q.quoted("text")
    kept = [frozenset(r.doc_id for r in df.where(Q.rejected_by(col, list(order)).isNull()).collect())
            for order in itertools.islice(itertools.permutations(rules), 0, 5040, 1700)]
    assert len(set(kept)) == 1
    assert frozenset(r.doc_id for r in Q.keep_good(df).collect()) == kept[0]


def test_cost_and_selectivity_give_the_order(spark):
    df = spark.createDataFrame([(k, "no symbols here " * 30) for k in range(50)], "doc_id long, text string")
    rules = [Q.Rule("never", lambda t: Q.F.length(t) < 0), Q.Rule("always", lambda t: Q.F.length(t) > 0)]
    got = Q.ordered_rules(df, rules)
    assert [r.name for r in got] == ["always", "never"] and [r.share for r in got] == [1.0, 0.0]
    assert all(r.cost > 0 for r in got)
    empty = df.limit(0)
    assert Q.quality_report(empty).collect() == []
