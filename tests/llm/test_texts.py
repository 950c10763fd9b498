"""Operators that read one text at a time, against plain versions and odd rows."""

import hashlib
import itertools
import random
import time

import numpy as np
import pytest

from panelloom.llm import fingerprints, language, licenses, pages, pieces, toxicity

from llm_helpers import SMALL, docs_of

ODD = [
    (None, "no id here"), (1, None), (2, ""), (3, "1 2 3 !?"), (4, "a"), (5, "word " * 4000),
    (5, "word " * 4000), (6, "é漢字 ▁ \n\t x"), (7, "\U000ffff0 end"),
]


# ---- pages ---------------------------------------------------------------------------------

CASES = [
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    ("<p>a &lt;b&gt; &amp; c<br>d\n  e", "a <b> & c d e"),
    ("<div hidden>x</div><p>y", "y"),
    ("<script>var t = '</p>';</script><style>p{}</style><p>only, this</p>", "only, this"),
    (
        "<nav><a href=/>Home</a></nav><article><h1>T</h1><p>One, two.<p>Three.</article>"
        "<aside>no</aside><footer>f</footer>",
        "T\n\nOne, two.\n\nThree.",
    ),
    (
        '<div id="page"><div class="content"><h1>Head</h1><p>Long, text, here.</p><p>More.</p>'
        '<ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div>'
        '<div class="sidebar"><p>side, note</p></div>'
        '<div id="comments"><p>bad, comment, here</p></div>'
        '<form><p>Mail, please, now</p></form></div>',
        "Head\n\nLong, text, here.\n\nMore.",
    ),
    ('<a title="x > y">t</a>', "t"),
    ("<table><tr><td>A<td>B</table>", "A\n\nB"),
    ("<" * 50, "<" * 50),
    ("<div>" * 3000 + "deep", "deep"),
    ("<article><p>x<aside>no</aside>y</article>", "x\n\ny"),
    ("<body class='has-sidebar'><p>kept</p></body>", "kept"),
]


LONG = "A sentence of the article, with commas, and with more words than a notice has."


@pytest.mark.parametrize(
    "name", ["relative overflow-hidden", "content no-sidebar", "layout-sidebar-right", "share-price", "popup", "hidden"]
)
def test_main_text_keeps_wrappers_with_skipped_words(name):
    for attribute in ("class", "id"):
        page = (
            f"<div>Copyright line</div><section {attribute}='{name}'><p>{LONG}</p><p>{LONG}</p>"
            "<div class='cookie-notice'><p>We use cookies, you know.</p></div></section>"
        )
        assert pages.main_text(page) == f"{LONG}\n\n{LONG}"


def test_main_text_keeps_links_within_the_article():
    links = "<li><a href=a>One source</a><li><a href=b>Two source</a>"
    found = pages.main_text(
        f"<article><ul>{links}</ul><p>{LONG}</p><ul>{links}</ul><p>{LONG}</p>"
        f"<h2>Sources</h2><ul>{links}</ul><table><tr><td><a href=c>Three</a><td><a href=d>Four</a></table></article>"
    )
    named = "One source\n\nTwo source"
    assert found == f"{LONG}\n\n{named}\n\n{LONG}\n\nSources\n\n{named}\n\nThree\n\nFour"


@pytest.mark.parametrize("source, want", CASES)
def test_main_text(source, want):
    assert pages.main_text(source) == want


def test_pages_table(spark):
    rows = [(i, f"u{i}", s, "old") for i, (s, _) in enumerate(CASES)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = {r["page_id"]: r for r in pages.extract(df).collect()}
    for i, (_, want) in enumerate(CASES):
        assert found[i]["text"] == want and found[i]["n_chars"] == len(want)
    assert found[None]["text"] == "" and pages.extract(df.limit(0)).count() == 0


def test_pages_of_the_table_have_their_article(spark):
    import html
    import re

    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    for r in rows:
        inner = r["html"].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        parts = [re.sub(r"<[^>]*>", "", p) for p in re.split(r"</?(?:p|h1)>", inner)]
        clean = [re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts]
        assert pages.main_text(r["html"]) == "\n\n".join(p for p in clean if p)


# ---- language ------------------------------------------------------------------------------


def test_language_scores_equal_plain_sums(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = language.learn(docs)
    assert model.languages == ("de", "en", "es", "fr")
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    truth = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    right = [found[d]["lang_pred"] == lang for d, (_, lang) in truth.items() if lang]
    assert np.mean(right) > 0.95
    for doc in sorted(found)[:5]:
        raw = [ord(c.lower()) if "A" <= c <= "Z" else ord(c) for c in truth[doc][0]]
        total = np.array(model.prior)
        for n in language.SIZES:
            for i in range(len(raw) - n + 1):
                own = np.array(raw[i : i + n], np.uint32)
                bucket = language.buckets_of(own, np.array([0, n]), n)[0][0]
                total = total + model.table[bucket].astype(float) / len(language.SIZES)
        assert model.languages[int(np.argmax(total))] == found[doc]["lang_pred"]
        chance = np.exp(total - total.max())
        assert abs(found[doc]["score"] - chance.max() / chance.sum()) < 1e-3


def test_language_grams_are_characters_of_one_text():
    texts = ["Ab", "é漢字x", "", "\U0001F600", "日本"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    codes, cuts = language.characters(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert codes.tolist() == [ord(c) for t in texts for c in t.replace("A", "a")]
    for n in language.SIZES:
        bucket, owner = language.buckets_of(codes, cuts, n)
        want = []
        for i, t in enumerate(texts):
            own = np.array([ord(c) for c in t.replace("A", "a")], np.uint32)
            for j in range(len(own) - n + 1):
                want.append((i, language.buckets_of(own[j : j + n], np.array([0, n]), n)[0][0]))
        assert list(zip(owner.tolist(), bucket.tolist())) == want
    total = np.zeros((5, 3))
    table = np.arange(language.BUCKETS * 3).reshape(-1, 3)
    bucket, owner = language.buckets_of(codes, cuts, 2)
    language.product(bucket, owner, table, total)
    assert [total[i].tolist() for i in range(5)] == [table[bucket[owner == i]].sum(axis=0).tolist() for i in range(5)]


def test_language_odd_rows(spark):
    docs = docs_of(spark, ODD)
    model = language.learn(docs.filter("doc_id > 4"))
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    nothing = language.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


# ---- toxicity ------------------------------------------------------------------------------


def brute_margin(text, model):
    slots = {int(b): i for i, b in enumerate(model.buckets)}
    own = [slots[t] for w in toxicity.words_in(text) for t in toxicity.terms_of(w) if t in slots]
    pairs = sum(model.vectors[a] @ model.vectors[b] for a, b in itertools.combinations(own, 2))
    return model.bias + sum(model.weights[i] for i in own) + pairs


def test_factorization_machine_learns_a_pair(spark):
    rng = random.Random(3)
    filler = [f"word{chr(97 + i)}" for i in range(26)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(filler, k=12)
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["zzinsult"] * a + ["qqgroup"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    docs = docs_of(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.learn(docs, marks.filter("doc_id < 600"))
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    assert np.mean([found[i]["predicted"] == y for i, y in labels[600:]]) > 0.97
    for i in range(0, 900, 100):
        want = 1 / (1 + np.exp(-np.clip(brute_margin(rows[i][1], model), -50, 50)))
        assert abs(found[i]["score"] - want) < 1e-9


def test_toxicity_learns_a_pair_of_balanced_terms(spark):
    rng = random.Random(3)
    filler = [f"word{chr(97 + i)}" for i in range(26)]
    rows, labels = [], []
    for i in range(900):
        a, b = divmod(i % 4, 2)
        words = rng.choices(filler, k=12) + ["zzinsult"] * a + ["qqgroup"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a == b)))
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.learn(docs_of(spark, rows), marks.filter("doc_id < 600"))
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs_of(spark, rows), model).collect()}
    assert np.mean([found[i] == y for i, y in labels[600:900]]) > 0.95


def test_toxicity_odd_rows(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1), (99, 0)], "doc_id bigint, toxic int")
    for marks in (labels, labels.limit(0), labels.filter("toxic = 1")):
        rows = toxicity.toxicity(docs, toxicity.learn(docs, marks)).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert docs.columns[:-1] == [c for c in rows[0].asDict() if c not in ("score", "predicted")]


# ---- fingerprints --------------------------------------------------------------------------


def brute_codes(text):
    k, s = fingerprints.K, fingerprints.S
    codes, last = [], None
    for p in range(len(text) - k + 1):
        window = np.frombuffer(text[p : p + k], np.uint8)
        inner = fingerprints.gram_hashes(window, s)
        if inner.min() in (inner[0], inner[-1]):
            with np.errstate(over="ignore"):
                whole = ((window.astype(np.uint64) + np.uint64(1)) * fingerprints.powers(k)).sum()
            high = int(fingerprints.mix(np.array([whole]))[0]) >> 40
            codes.append(high << 8 | (min(p - last, 255) if last is not None else 0))
            last = p
    if not codes and text:
        codes = [int.from_bytes(hashlib.sha256(text).digest()[:3], "big") << 8]
    return codes


def brute_next(rows):
    keyed = [(-(2**63) if i is None else i, i, t or "") for i, t in rows]
    ordered = sorted(keyed, key=lambda r: (-r[0], r[2]))
    out = []
    for n, (_, doc, text) in enumerate(ordered):
        after = ordered[(n + 1) % len(ordered)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new, other = (brute_codes(t.encode()) for t in (text, edited, after))
        out.append((
            doc, len(text), hashlib.sha256(edited.encode()).hexdigest(),
            "".join(f"{c:08x}" for c in own), "".join(f"{c:08x}" for c in new),
            likeness(own, new), likeness(own, other),
        ))
    return sorted(out, key=str)


def likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    left, right = ({c: x.count(c) for c in x} for x in (a, b))
    keys = left.keys() | right.keys()
    common = sum(min(left.get(k, 0), right.get(k, 0)) for k in keys)
    return common / sum(max(left.get(k, 0), right.get(k, 0)) for k in keys)


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i * 7 % 101, "".join(rng.choices("abcdé \n", k=rng.randint(0, 300)))) for i in range(60)]
    for sample in (rows, rows[:1], [r for r in ODD if len(r[1] or "") < 500]):
        found = fingerprints.compare_with_next(docs_of(spark, sample).repartition(3)).collect()
        assert sorted((tuple(r) for r in found), key=str) == brute_next(sample)
    assert fingerprints.compare_with_next(docs_of(spark, rows).limit(0)).count() == 0


def test_equal_texts_have_equal_fingerprints(spark):
    rows = fingerprints.fingerprints(docs_of(spark, ODD)).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len(rows) == len(ODD) and len(by_id[5]) == 1 and by_id[1] == by_id[2] == {""}


# ---- pieces --------------------------------------------------------------------------------


def brute_best(marked, v):
    best = [0.0] + [-1e18] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(end):
            piece = marked[start:end]
            score = v.scores.get(piece)
            if score is None:
                if end - start > 1:
                    continue
                score = -pieces.BYTE_COST * len(piece.encode())
            best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_streaming_search_is_optimal_and_exact():
    v = pieces.load()
    encoder, table = pieces.Encoder(v), v.decoder()
    names = {i: p for p, i in v.ids.items()}
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("the onéß ▁\n\t漢x  aerit", k=rng.randint(0, 120)))
        ids = encoder.encode(text)
        assert b"".join(table[i] for i in ids).decode() == text
        if pieces.SPACE not in text:
            got = sum(v.scores[names[i]] if i in names else -pieces.BYTE_COST for i in ids)
            whole = [i for run in pieces.viterbi(text.replace(" ", pieces.SPACE), v) for i in run]
            assert abs(got - brute_best(text.replace(" ", pieces.SPACE), v)) < 1e-6
            assert len(ids) == len(whole)
    runs = list(pieces.viterbi("ab" * 500, v))
    assert len(runs) > 20  # ids are handed out on the way


def test_pieces_round_trip(spark):
    docs = docs_of(spark, ODD)
    tokens = pieces.encode(docs)
    rows = tokens.collect()
    assert all(r["round_trip"] for r in rows) and len(rows) == len(ODD)
    back = sorted(r["text"] for r in pieces.decode(tokens).collect())
    assert back == sorted(t or "" for _, t in ODD)
    assert pieces.encode(docs.limit(0)).count() == 0


# ---- licenses ------------------------------------------------------------------------------


def test_licenses(spark):
    notices = {
        "MIT": "Released under the MIT License.",
        "GPL": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    }
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = licenses.learn(docs)
    found = {r["doc_id"]: r for r in licenses.scan(docs, model).collect()}
    for r in docs.collect():
        named = {f for f, line in notices.items() if line in (r["text"] or "")}
        assert {x["family"] for x in found[r["doc_id"]]["licenses"] if x["confirmed"]} == named
    odd = licenses.scan(docs_of(spark, [*ODD, (9, "x\nReleased under the MIT License.\n")]), model)
    rows = {r["doc_id"]: r for r in odd.collect()}
    assert rows[9]["family"] == "MIT" and rows[9]["licenses"][0]["paragraph"] == 1
    assert rows[1]["n_paragraphs"] == 0 and rows[4]["family"] is None
    assert licenses.classify("a license for fishing in the lake", model)[3] is False


def test_licenses_of_other_notices_and_tags():
    model = licenses.fit([f"plain words about the river and the town number {i}" for i in range(200)])
    for line, family in {
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "// SPDX-License-Identifier: MIT": "MIT",
        "# SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": "GPL",
        "/* SPDX-License-Identifier: LGPL-2.1+ */": "LGPL",
        "SPDX-License-Identifier: CC-BY-SA-4.0": "CC-BY-SA",
        "This file is distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "This module is licensed under the Eclipse Public License version 2.0": "EPL",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted": "ISC",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications": "Zlib",
        "This is free and unencumbered software released into the public domain, says the file.": "Unlicense",
        "Licensed under the Apache-2.0 license.": "Apache-2.0",
    }.items():
        found = licenses.classify(line, model)
        assert (found[0], found[3]) == (family, True), (line, found)
    for text in ("(MIT OR Apache-2.0)", "MIT AND (Apache-2.0 WITH LLVM-exception). Not ISC"):
        assert licenses.tagged(f"SPDX-License-Identifier: {text}") == ["MIT", "Apache-2.0"]
    assert licenses.classify("SPDX-License-Identifier: Python-2.0", model)[0] == licenses.UNKNOWN


# ---- pages: names and time ------------------------------------------------------------------


def _paragraphs(word, n):
    return "".join(f"<p>{word} number {i}, which goes on, and on, with words to read.</p>" for i in range(n))


@pytest.mark.parametrize("page", [
    "<div class=content>{art}</div><div id=comments class=comments>{com}</div>",
    "<article>{art}</article><section id=comments>{com}</section>",
    "<article>{art}<section class='comment-list'>{com}</section></article>",
    "<div>{art}</div><div class='cookie-notice'>{com}</div>",
    "<div>{art}</div><div class='sidebar'><div class='ads'>{com}</div></div>",
    "<div class='overlay'>{art}</div><div class='comments'>{com}</div><div>1 Jan</div>",
])
def test_comments_and_notices_never_win(page):
    text = pages.main_text(page.format(art=_paragraphs("Art", 3), com=_paragraphs("Com", 12)))
    assert text.count("Art") == 3 and "Com" not in text


def test_named_blocks_count_where_nothing_else_has_text():
    assert pages.main_text("<div class=comments><p>Only this.</p></div>") == "Only this."
    assert pages.main_text("<div class=sidebar><p>This.</p></div><div class=ads><p>Not.</p></div>") == "This."


def test_deep_pages_take_linear_time():
    def took(n):
        source = "<div>" * n + "<p>a, b</p><ul><li><a href=x>u</a><li><a>w</a></ul>" * n + "</div>" * n
        source += "<p><button>" + "<div><i>" * n + "x"
        started = time.process_time()
        pages.main_text(source)
        return time.process_time() - started

    took(200)
    assert took(8000) < 16 * max(took(1000), 0.05)
