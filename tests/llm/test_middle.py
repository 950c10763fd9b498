import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from panelloom.llm import middle

from llm_helpers import docs_of

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def cut(text, h, fim=100, spm=50):
    """Brute force: (n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def numbers(doc, seed=7):
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


TEXT = st.text(st.sampled_from("\n\r<>PSMaé語 "), max_size=20)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, *[st.integers(0, 2**32 - 1)] * 4), max_size=8))
def test_kernels_equal_brute_force(rows):
    drawn = [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5)]
    texts = pa.array([r[0] for r in rows], pa.string())
    found = middle.rewrite(texts, drawn, 70, 30)
    assert [tuple(c[i].as_py() for c in found) for i in range(len(rows))] == [
        cut(r[0], r[1:], 70, 30) for r in rows
    ]
    assert middle.rebuild(found[4], found[1]).to_pylist() == [r[0] for r in rows]


def test_tables(spark):
    long = "é" * 3_000_000 + "\n" + "x\n" * 200_000
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, None), (None, "x\ny\n"), (3, ""), (4, long), (5, "<M>\n"), (-6, "\n")]
    docs = docs_of(spark, rows).withColumnRenamed("score", "output").repartition(3)
    found = middle.restore(middle.fill_in_middle(docs))
    assert found.columns == [
        "doc_id", "text", "lang", "source", "n_chars", "n", "form", "prefix_chars", "middle_chars",
        "output", "restored",
    ]
    got = [(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()]
    want = [(d, t, *cut(t, numbers(d))) for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert found.filter("restored <> coalesce(text, '') or restored is null").count() == 0


def test_empty_table_and_shares(spark):
    assert middle.restore(middle.fill_in_middle(docs_of(spark, []))).count() == 0
    docs = docs_of(spark, [(i, "a\nb\nc\n") for i in range(400)])
    forms = {r.form: r["count"] for r in middle.fill_in_middle(docs, fim_percent=50).groupBy("form").count().collect()}
    assert 140 < forms["plain"] < 260 and abs(forms["psm"] - forms["spm"]) < 60
