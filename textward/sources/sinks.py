"""Sinks: CSV, seed scripts, audit logs, thresholds, models, compaction."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Chosen columns with a header; others are ignored."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False)


def _insert(df: DataFrame, section: int, name: str, columns: list[str], numbers: set[str], order: list[str]) -> DataFrame:
    """(section, place, line): INSERT with a row on each line, the last closed by a semicolon."""
    values = F.concat(F.lit("  ("), F.concat_ws(", ", *[F.col(c).cast("string") if c in numbers else quote(F.col(c)) for c in columns]), F.lit(")"))
    from pyspark.sql import Window

    # The lexicon's size is bounded by the curated list, so one task may number it.
    rows = df.select(F.row_number().over(Window.orderBy(*order)).alias("place"), values.alias("line"))
    last = rows.agg(F.max("place").alias("last"))
    ended = rows.join(F.broadcast(last)).select("place", F.concat("line", F.when(F.col("place") == F.col("last"), ";").otherwise(",")).alias("line"))
    head = last.where("last is not null").select(F.lit(0).alias("place"), F.lit(f"INSERT INTO {name} ({', '.join(columns)}) VALUES").alias("line"))
    return head.union(ended).select(F.lit(section).alias("section"), "place", "line")


def seed_script(words: DataFrame, variations: DataFrame, whitelist: DataFrame) -> DataFrame:
    """The lines of a script that fills the store: children deleted before parents, then three INSERTs.
    Columns section, place, line; order by the first two."""
    spark = words.sparkSession
    drops = [(1, "DELETE FROM WordVariations;"), (2, "DELETE FROM BadWords;"), (3, "DELETE FROM Whitelist;")]
    from .tables import literal

    head = literal(spark, ["place", "line"], drops).select(F.lit(0).alias("section"), "place", "line")
    return (
        head.union(_insert(words, 1, "BadWords", ["Id", "Word", "NormalizedWord", "Category", "Severity"], {"Id", "Severity"}, ["Id"]))
        .union(_insert(variations, 2, "WordVariations", ["Id", "BadWordId", "Variation", "NormalizedVariation", "Source"], {"Id", "BadWordId"}, ["Id"]))
        .union(_insert(whitelist, 3, "Whitelist", ["Phrase", "NormalizedPhrase", "Scope", "Reason"], set(), ["NormalizedPhrase", "Scope"]))
    )


def write_script(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("section", "place").select("line").write.mode("overwrite").text(path)


def save_store(words: DataFrame, variations: DataFrame, whitelist: DataFrame, path: str) -> dict[str, int]:
    """The three tables as Parquet with IsActive and CreatedAt, as at creation; returns their row counts."""
    out = {}
    for name, df in (("BadWords", words), ("WordVariations", variations), ("Whitelist", whitelist)):
        full = df.withColumn("CreatedAt", F.current_timestamp())
        full = full.withColumn("IsActive", F.lit(True)) if name != "Whitelist" else full
        full.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    return out


def append_audit(entries: DataFrame, path: str) -> None:
    """Audit entries as JSON lines with the time; a failing log never fails the caller."""
    try:
        stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        entries.select(stamp.alias("timestamp"), *entries.columns).write.mode("append").json(path, ignoreNullFields=False)
    except Exception as e:  # noqa: BLE001  whatever the file system raises
        print(f"warning: could not write audit log: {e}")


def write_thresholds(decided: DataFrame, path: str, label: str = "label", default: float = 0.5) -> None:
    """One row for each label to a JSON file."""
    rows = decided.collect()
    body = {"default": default, "thresholds": {r[label]: r["threshold"] for r in rows}, "reasons": {r[label]: r["reason"] for r in rows}}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2, ensure_ascii=False)
        f.write("\n")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def compact(df: DataFrame, path: str, files: int) -> None:
    """Rewrite a table into a given number of files."""
    df.repartition(files).write.mode("overwrite").parquet(path)
