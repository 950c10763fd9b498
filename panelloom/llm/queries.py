"""One query per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import (
    fingerprints,
    jaccard,
    language,
    licenses,
    middle,
    nearest,
    pages,
    paths,
    pieces,
    ranked,
    suffixes,
    toxicity,
)
from panelloom.llm.common import table
from panelloom.llm.mixing import mix_sources
from panelloom.llm.registry import QUERIES, SQL, query  # noqa: F401


def fold(modulus: int) -> Column:
    """Remainder of the checksum of the id as text; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text; fold 2 of 4 is held out of learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.filter(fold(4) != 2))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score"
    )


@query("op1_pages")
def op1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op2_jaccard")
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and class of near copies of every text."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@query("op4_suffixes")
def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 50-byte strings of smaller documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs).drop("text")


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of the decoded bytes."""
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_licenses")
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License families named by the paragraphs of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.learn(docs))


@query("op7_nearest")
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector, by Euclidean distance."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text; fold 0 of 5 is held out of learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn(docs, labels.filter(fold(5) != 0))
    return toxicity.toxicity(docs, model).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted"
    )


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, compared with the next document's."""
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def _split(level: int, child: str, parent: str) -> str:
    """SQL of one level of the budget tree: children of ``parent`` nodes by ``child``."""
    keys = ["domain", "lang", "source"][:level]
    up = ", ".join(keys[:-1])
    part = f"PARTITION BY {up}" if up else ""
    budget = f"JOIN {parent} USING ({up})" if up else f"CROSS JOIN {parent}"
    return f"""
{child}_n AS (SELECT {", ".join(keys)}, CAST(sum(tokens) AS DOUBLE) * 4 AS room,
    CAST(1 AS DOUBLE) AS weight FROM leaves GROUP BY ALL),
{child}_b AS (SELECT n.*, budget, room / weight AS ratio FROM {child}_n n {budget}),
{child}_o AS (SELECT *,
    coalesce(sum(room) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room_before,
    sum(weight) OVER ({part}) - coalesce(sum(weight) OVER
      (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM {child}_b WINDOW w AS ({part} ORDER BY ratio, {keys[-1]})),
{child}_f AS (SELECT *, max(CASE WHEN (budget - room_before) * weight >= room * weight_left
    THEN 0 ELSE 1 END) OVER ({part} ORDER BY ratio, {keys[-1]}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broke FROM {child}_o),
{child}_r AS (SELECT *, min(CASE WHEN broke = 1 THEN {{'ratio': ratio, 'name': {keys[-1]},
    'room_before': room_before, 'weight_left': weight_left}} END) OVER ({part}) AS edge
  FROM {child}_f),
{child} AS (SELECT {", ".join(keys)}, CASE WHEN broke = 0 THEN room ELSE least(room,
    (budget - edge.room_before) / edge.weight_left * weight) END AS budget FROM {child}_r)"""


MIXING_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'd' || translate(substr(md5(coalesce(source, '')), 1, 1), '0123456789abcdef',
      '0000111122223333') AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM d GROUP BY ALL
  HAVING sum(tokens) > 0),
root AS (SELECT CAST(coalesce(sum(tokens), 0) AS DOUBLE) * 0.9::DOUBLE AS budget FROM leaves),
{_split(1, "domains", "root")},
{_split(2, "langs", "domains")},
{_split(3, "sources", "langs")},
budgets AS (SELECT domain, lang, source, CAST(floor(budget) AS BIGINT) // CAST(tokens AS BIGINT)
    AS passes, CAST(floor(budget) AS BIGINT) % CAST(tokens AS BIGINT) AS rest
  FROM sources JOIN leaves USING (domain, lang, source)),
placed AS (SELECT d.*, passes, rest, md5('42|' || passes || '|' ||
    coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM d JOIN budgets USING (domain, lang, source)),
started AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) -
    sum(tokens) OVER (PARTITION BY domain, lang, source, place) AS start FROM placed),
counted AS (SELECT doc_id, domain, lang, source, tokens,
    passes + CASE WHEN start < rest THEN 1 ELSE 0 END AS n FROM started)
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(n)) AS INTEGER) AS epoch
FROM counted
"""


@query("op8_mixing", MIXING_SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn for a budget of nine tenths of all tokens, equal weights per level."""
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "domain", "lang", "source", "tokens", "epoch"
    )


MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, ('0x' || substr(digest, 1, 8))::BIGINT AS h1,
    ('0x' || substr(digest, 9, 8))::BIGINT AS h2, ('0x' || substr(digest, 17, 8))::BIGINT AS h3,
    ('0x' || substr(digest, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:lo], '') AS prefix,
    array_to_string(units[lo + 1:hi], '') AS middle, array_to_string(units[hi + 1:n], '') AS suffix
  FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


@query("op13_middle", MIDDLE_SQL)
def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every text dealt to prefix, middle and suffix, and the text rebuilt from that."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = middle.restore(middle.fill_in_middle(docs))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


RANKED_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT row, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY row),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
p AS (SELECT row, doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM d
  WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, s GROUP BY term, docs),
g AS (SELECT item_id, text, row, doc_id, CAST(sum(w * ((1000000000 * tf) //
    (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN n USING (row), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text
    ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM g WHERE score > 0 QUALIFY rank <= 10
"""


@query("op12_ranked", RANKED_SQL)
def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for every benchmark item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return ranked.rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), items)


@query("op11_paths")
def op11_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and class of near copies of every text, by chosen paths."""
    return paths.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
