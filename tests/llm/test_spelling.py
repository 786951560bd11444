import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.fixtures import hard_docs, hard_rows, no_docs
from tieout.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def grouped(words):
    """word -> (form, root, n, n_near, form_n) by comparing words that share what deleting a letter leaves."""
    left, near, form = defaultdict(set), defaultdict(set), {}
    for w in words:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            left[x].add(w)
    for some in left.values():
        for a in some:
            near[a] |= {b for b in some if one_edit(a, b)}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def got_of(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def texts(seed, n=150):
    """Words over few letters, with slips, so that near words and chains of forms are many."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abéÜ×o") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(0, 150)):
            w = stems[min(int(rng.expovariate(0.2)), 39)]
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(("", "a", "ab", "Z")) + w[at + 1 :] or w
            own.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("most", [spelling.MOST_IN_BUCKET, 2])
def test_against_comparing_words(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST_IN_BUCKET", most)
    rows = texts(3) + [(None, "abcabc " * 9), (None, None), (7, ""), (8, "é" * 9000 + " 12 x")]
    want = grouped(counted(rows))
    assert len(want) > 100 and sum(x[0] is not None for x in want.values()) > 20
    assert got_of(spelling.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want


def test_hard_rows(spark):
    assert got_of(spelling.query(hard_docs(spark))) == grouped(counted([r[:2] for r in hard_rows()]))
    assert spelling.query(no_docs(spark)).count() == 0


def test_near_words_share_a_signature():
    """Over all single edits of random words."""
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 12)))
        own = set(spelling.signatures(w, 3))
        for i in range(len(w) + 1):
            for other in {w[:i] + "z" + w[i:], w[:i] + "a" + w[i + 1 :], w[:i] + w[i + 1 :]}:
                if len(other) >= 6 and other != w:
                    assert own & set(spelling.signatures(other, 3)), (w, other)


def test_long_chains_reach_their_last(spark):
    chain = [f"w{i}" for i in range(23)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {(r["word"], r["root"]) for r in spelling.roots(forms).collect()} == {(w, chain[-1]) for w in chain[:-1]}


def test_nothing_is_broadcast_however_small_spark_sizes_it(spark, monkeypatch):
    """Signatures are sized as the words they are made of; 0.5 GB of documents did not fit the driver so."""
    plans = []

    def write_table(df, name, own=spelling.write_table):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df, name)

    monkeypatch.setattr(spelling, "write_table", write_table)
    made = spelling.query(spark.createDataFrame(texts(3), "doc_id long, text string"))
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 6 and not any("Broadcast" in p for p in plans)
