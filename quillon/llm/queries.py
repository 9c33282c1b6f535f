"""The queries of this subpackage and, where SQL can state them, the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import p10_residue, p1_rank, p2_forms, p3_sentences, p4_topn, p5_markup, p6_level, p7_repetition, p8_encode, p9_pack
from quillon.session import checkpointed
from quillon.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three results of each batch in the combined ranking."""
    ranked = p1_rank.aggregate_ranks(table(spark, sf_dir, "punch"), "batch_id", "result_id")
    return p1_rank.first_in_group(ranked, "batch_id", "result_id", 3).select("batch_id", "result_id")


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid result with its normalised ranks and significance."""
    ranked = p1_rank.aggregate_ranks(table(spark, sf_dir, "punch"), "batch_id", "result_id")
    floats = [c for c, t in ranked.dtypes if t == "double"]
    return ranked.withColumns({c: F.round(c, 6) for c in floats})


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = p2_forms.vocabulary((table(spark, sf_dir, "results"), "text"), (table(spark, sf_dir, "hits"), "text"))
    return checkpointed(p2_forms.canonical(counted))


def _prints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known = _canonical(spark, sf_dir)
    hits = table(spark, sf_dir, "hits").filter("result_id IS NOT NULL")
    # written once, as classes and pairs ask for them several times
    return checkpointed(p2_forms.fingerprints(table(spark, sf_dir, "results"), ["result_id"], "text", known)), checkpointed(p2_forms.fingerprints(hits, ["hit_id", "result_id"], "text", known))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results, and hits of one result, that look the same but are not the same characters."""
    results, hits = _prints(spark, sf_dir)
    of_results = p2_forms.look_alike_pairs(results, "result_id").select(F.lit("results").alias("tbl"), "id_a", "id_b")
    of_hits = p2_forms.look_alike_pairs(hits, "hit_id", ["result_id"]).select(F.lit("hits").alias("tbl"), "id_a", "id_b")
    return of_results.unionByName(of_hits)


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that looks like a row of other characters: its class and the number of such rows."""
    results, hits = _prints(spark, sf_dir)
    of_results = p2_forms.look_alike_classes(results, "result_id").select(F.lit("results").alias("tbl"), F.col("id").alias("row_id"), F.col("form_fp").alias("class_id"), "links")
    of_hits = p2_forms.look_alike_classes(hits, "hit_id", ["result_id"]).select(F.lit("hits").alias("tbl"), F.col("id").alias("row_id"), F.md5(F.concat_ws(" ", "result_id", "form_fp")).alias("class_id"), "links")
    return of_results.unionByName(of_hits)


def p2_forms_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of every text of results and hits."""
    known = _canonical(spark, sf_dir)
    results = p2_forms.forms(table(spark, sf_dir, "results"), ["result_id"], "text", known)
    hits = p2_forms.forms(table(spark, sf_dir, "hits").dropDuplicates(["hit_id"]), ["hit_id"], "text", known)
    return results.select(F.lit("results").alias("tbl"), F.col("result_id").alias("row_id"), "form").unionByName(
        hits.select(F.lit("hits").alias("tbl"), F.col("hit_id").alias("row_id"), "form")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every span, and of every result in a .txt file, with its offsets."""
    spans = p3_sentences.sentences(table(spark, sf_dir, "spans"), "span_id", "text", "lang").distinct()  # some are delivered twice
    plain = table(spark, sf_dir, "results").filter(F.col("path").endswith(".txt"))
    results = p3_sentences.sentences(plain, "result_id", "text", "lang")
    cols = ["row_id", "start_off", "end_off"]
    return spans.toDF(*cols).select(F.lit("spans").alias("tbl"), *cols).unionByName(results.toDF(*cols).select(F.lit("results").alias("tbl"), *cols))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three scored paragraphs of each path."""
    top = p4_topn.top_n_by_bands(table(spark, sf_dir, "paragraph_scores"), "path", "para_index", "weighted", "scored_at")
    return top.select("path", "para_index")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every heading, list item, code block and formula of a result with markup."""
    return p5_markup.elements(table(spark, sf_dir, "results"), "result_id", "text", "path")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every result."""
    return p5_markup.clean_texts(table(spark, sf_dir, "results"), "result_id", "text", "path")


def _host():
    """Folder and suffix of a path; texts without path are a host of their own, null."""
    host = F.concat_ws(" ", F.split_part("path", F.lit("/"), F.lit(1)), F.regexp_extract("path", r"\.(\w+)$", 1))
    return F.when(F.col("path").isNotNull(), host)


def p5_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiters that occur alike over the texts of a host."""
    return p5_markup.template_classes(table(spark, sf_dir, "results"), "result_id", "text", _host())


def p5_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the slots of the template deduced for each host."""
    return p5_markup.template_slots(table(spark, sf_dir, "results"), "result_id", "text", _host())


def _levels(spark: SparkSession, sf_dir: str, results: DataFrame) -> DataFrame:
    tables = (table(spark, sf_dir, t) for t in ("grade_samples", "stylometry", "reader_signals"))
    return p6_level.graded(results, *tables, "result_id", "text", "lang")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English results of .txt files at the most demanding level."""
    rows = _levels(spark, sf_dir, table(spark, sf_dir, "results").filter(F.col("path").endswith(".txt")))
    return rows.filter("level = 3").select("result_id").distinct()


def p6_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every English result, with its score and what the measured indices say."""
    rows = _levels(spark, sf_dir, table(spark, sf_dir, "results"))
    return rows.withColumns({c: F.round(c, 6) for c in ("score", "text_level", "evidence_level")})


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated content of every result, and how sure it is that it repeats itself."""
    return p7_repetition.judged(table(spark, sf_dir, "results"), table(spark, sf_dir, "hits"), "result_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that more likely than not repeat themselves, by the posterior, and whose exact share is 40 per cent or more."""
    rows = p7_shares(spark, sf_dir).filter(F.col("posterior") >= 0.5)
    return rows.filter(F.col("share") >= p7_repetition.THRESHOLD).select("result_id").distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte_bpe_50k ids of every document."""
    return p8_encode.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container, place and offset of every document or piece of one."""
    sizes = p8_encode.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p9_pack.pack(sizes, "doc_id", "n_tokens")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold template residue, filler or an error page in place of content."""
    rows = p10_residue.scored(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return rows.filter("residue").select("doc_id").distinct()


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the documents free of these, with their scores."""
    rows = p10_residue.scored(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return rows.filter("NOT residue").select("doc_id", F.round("score", 6).alias("score"))


def p10_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the classifier on hosts it never saw, against the weak labels."""
    _, figures = p10_residue.train(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return spark.createDataFrame([(k, float(v)) for k, v in figures.items()], "measure string, value double")


QUERIES = {
    "p1_found": p1_found,
    "p1_ranking": p1_ranking,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p2_forms_of_texts": p2_forms_of_texts,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_clean": p5_clean,
    "p5_slots": p5_slots,
    "p5_template": p5_template,
    "p6_found": p6_found,
    "p6_levels": p6_levels,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_clean": p10_clean,
    "p10_validation": p10_validation,
}

from quillon.llm.sql import ORACLE  # noqa: E402, F401
