"""The minimal slice: a mixture over documents, scored by count and length (U06, J09, J19,
U01, A25, G01, G28)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import table
from weft.ids import positions_by_key, read_with_row_id
from weft.operators.adapters import caption_samples
from weft.operators.aggregates import sample_length
from weft.plans.mixture import build_mixture

WORDS_SQL = r"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


def words_sql(x: str) -> str:
    return WORDS_SQL.format(x=x)


def doc_datasets(spark: SparkSession, sf_dir: str):
    """Registry over ``documents``: all rows, and the English rows as their own dataset."""

    def unnumbered() -> DataFrame:
        return table(spark, sf_dir, "documents").withColumn("row_id", F.lit(None).cast("bigint"))

    def docs_all(numbered: bool = True) -> DataFrame:
        src = read_with_row_id(spark, f"{sf_dir}/documents.parquet") if numbered else unnumbered()
        return caption_samples(src, "docs_all")

    def docs_en(numbered: bool = True) -> DataFrame:
        english = F.col("lang") == "en"
        if not numbered:
            return caption_samples(unnumbered().filter(english), "docs_en")
        src = read_with_row_id(spark, f"{sf_dir}/documents.parquet", "src_row").filter(english)
        return caption_samples(positions_by_key(src, ["src_row"], ["src_row"], name="row_id"), "docs_en")

    return {"docs_all": docs_all, "docs_en": docs_en}


def doc_ignore_lists(spark: SparkSession, sf_dir: str, datasets):
    """Ignore list ``noisy``: positions of samples whose document has quality 0."""

    def lists(name: str, subset: str) -> DataFrame:
        if subset != "noisy":
            raise ValueError(f"unknown ignore list {subset}")
        bad = table(spark, sf_dir, "labels").filter(F.col("quality") == 0).select(F.col("doc_id").cast("string"))
        ds = datasets[name]().select("sample_id", "row_id")
        return ds.join(bad, ds.sample_id == bad.doc_id, "left_semi").select("row_id")

    return lists


def mixture_report(spark: SparkSession, sf_dir: str, expr: str = "docs_en*2+docs_all@noisy") -> DataFrame:
    datasets = doc_datasets(spark, sf_dir)
    mix = build_mixture(expr, datasets, ignore_lists=doc_ignore_lists(spark, sf_dir, datasets))
    mix = sample_length(mix)
    caption = F.col("turns")[1]["value"]
    return mix.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.length(caption)).cast("bigint").alias("n_chars"),
        F.sum("length").cast("bigint").alias("n_tokens"),
    )


query(
    "u06_mixture_report",
    f"""
WITH parts AS (
  SELECT 'docs_all' AS dataset, text FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
  UNION ALL
  SELECT 'docs_en' AS dataset, text FROM documents, range(2) WHERE lang = 'en'
)
SELECT dataset, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars,
       sum(1 + {words_sql('text')} + 128)::BIGINT AS n_tokens
FROM parts GROUP BY dataset""",
)(mixture_report)


@query("s03_row_ids", "SELECT doc_id, row_number() OVER () - 1 AS row_id FROM documents")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers by the files' own metadata, against the order in which the table stands in them."""
    return read_with_row_id(spark, f"{sf_dir}/documents.parquet").select("doc_id", "row_id")
