"""The registered queries of this subpackage: thin contracts over its operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, html_extract, language_id, licenses, media, near_dedup, ngram_join, packing, periodic_runs, repeats, toxicity, warc
from .common import let, stored, table

HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = ngram_join.ngram_join(table(spark, sf_dir, "documents"), with_links=False)
    return groups


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sniffed = media.sniff_media(media.encode_text(table(spark, sf_dir, "documents")))
    payload = F.col("payload")
    return sniffed.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(";", "mime", F.when(F.col("corrected"), "corrected").otherwise("as declared"), F.concat(F.lit("embedded="), F.size("embedded").cast("string")), F.expr("array_join(transform(embedded, e -> concat(e.mime, '@', e.offset, '+', e.length)), ',')")).alias("feature"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(stored(pieces.drop("token_ids"), "pieces"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(f"not ({HELD_OUT})"))
    scored = toxicity.detect(docs, model, passages=False)
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(f"not ({HELD_OUT})"))
    scored = language_id.identify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(warc.write_archives(table(spark, sf_dir, "pages")), "warc")
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment(table(spark, sf_dir, "documents").select("doc_id", "text"), first, second, groups=False)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        """From word g % n on, words repeat with the contract's period."""
        a = g % F.size(words)
        p = 1 + F.floor((F.size(words) - a) / (3 + g % 8))
        return F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))

    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    text = F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.array_join(let(words, periodic), " ")).otherwise(F.col("text"))
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    found = found.withColumn("best", best)
    start, length, period = -F.col("best.col2"), F.col("best.length"), -F.col("best.col3")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_media_columns, op3_best_fit_packing, op4_benchmark_decontamination, op5_suffix_array_dedup, op6_license_scan, op7_toxicity, op8_language_id, op9_warc, op10_html_extraction, op11_tokenizer_alignment, op12_periodic_runs, op13_minhash_near_dedup)}

_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_words = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')".format
_shingles = "unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')))"

#: The license scan by its definition: every shingle of every text against every template. The others are beyond SQL; tests/llm has brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_license_scan": f"""WITH t(license, part, body) AS (VALUES {", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in licenses.TEMPLATES)}),
 theirs AS (SELECT DISTINCT license, part, {_shingles} AS s FROM (SELECT license, part, {_words("body")} AS w FROM t)),
 n AS (SELECT license, part, count(*) AS n_shingles FROM theirs GROUP BY ALL),
 own AS (SELECT DISTINCT doc_id, {_shingles} AS s FROM (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL)),
 hits AS (SELECT doc_id, license, part, count(*) AS n_found FROM own JOIN theirs USING (s) GROUP BY ALL)
 SELECT doc_id, license, part, n_shingles, n_found, round(n_found / n_shingles, 4) AS containment FROM hits JOIN n USING (license, part) WHERE round(n_found / n_shingles, 4) >= {licenses.CONTAINMENT}"""
}
