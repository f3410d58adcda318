"""The queries of this package: name -> (query, SQL twin or None). Each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplog.llm.frames import fold, small_batches

Query = Callable[[SparkSession, str], DataFrame]

# The id that ends a document in the packing and file queries.
END_ID = 2

REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        REGISTRY[name] = (query, sql)
        return query

    return keep


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op10_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm.quality_rules import judge

    return judge(documents(spark, sf_dir))


@register("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm import language_id as op

    docs = documents(spark, sf_dir)
    model = op.fit(docs, fold(F.col("doc_id"), 4) != 2)
    found = op.predict(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


@register("op5_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm import quality_classifier as op

    docs = documents(spark, sf_dir)
    model = op.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 4) != 2)
    return op.predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@register("op3_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), END_ID, bare=True)


@register("op4_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm.byte_bpe import round_trip_digests

    return round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op7_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm.token_files import token_digests, write_tokens

    return token_digests(write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), END_ID))


@register("op9_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm.license_scan import scan

    return scan(documents(spark, sf_dir))


@register("op8_lm_score")
def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm.lm_score import score

    found = score(documents(spark, sf_dir), fold(F.col("doc_id"), 5) != 1)
    return found.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False)))


@register("op1_minhash_dedup")
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm.minhash_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), size=2, threshold=80)


@register("op2_embedding_dedup")
def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm.embedding_dedup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


def _sides(k: int) -> str:
    """The cuts of a phrase of k words: score, size of the first part, and the counts of both parts."""
    cut = "{{'score': CAST(2000000::HUGEINT * x.a // (f{j}.a + g{j}.a) AS BIGINT), 'k': {j}, 'l': f{j}.a, 'r': g{j}.a}}"
    return ", ".join(cut.format(j=j) for j in range(1, k))


def _parts(k: int) -> str:
    join = "JOIN f f{j} ON f{j}.lang = x.lang AND f{j}.phrase = array_to_string(x.ws[1:{j}], ' ') JOIN f g{j} ON g{j}.lang = x.lang AND g{j}.phrase = array_to_string(x.ws[{i}:], ' ')"
    return " ".join(join.format(j=j, i=j + 1) for j in range(1, k))


_COLLOCATIONS = f"""
WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM
  (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
words AS (SELECT lang, [w FOR w IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF w <> ''] AS ws FROM pieces),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY lang HAVING n > 0),
placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
f AS (SELECT lang, k, phrase, count(*) AS a FROM
  (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM placed, range(1, 5) AS r(k) WHERE i + k - 1 <= len(ws)) GROUP BY ALL HAVING a >= 30),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
scored AS (
  {" UNION ALL ".join(f"SELECT x.lang, x.phrase, x.a, list_min([{_sides(k)}]) AS cut FROM (SELECT * FROM c WHERE k = {k}) x {_parts(k)}" for k in (2, 3, 4))}),
inside AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM c, range(2, 4) AS s(m), range(1, 4) AS t(i) WHERE m < k AND i + m - 1 <= k),
covered AS (SELECT DISTINCT s.lang, s.phrase FROM scored s JOIN inside y ON y.lang = s.lang AND y.phrase = s.phrase WHERE 100 * y.a >= 80 * s.a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank, phrase, a, cut.l AS l, cut.r AS r, n, cut.score AS score
  FROM scored ANTI JOIN covered USING (lang, phrase) JOIN total USING (lang)) WHERE rank <= 2000"""


@register("op11_collocations", _COLLOCATIONS)
def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm import collocations as op

    return op.collocations(documents(spark, sf_dir))


@register("op12_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm.whitening import whiten

    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@register("op13_text_signatures")
def text_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sweeplog.llm.text_signatures import compare_neighbours

    found = compare_neighbours(documents(spark, sf_dir))
    prints = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return found.withColumns(prints)
