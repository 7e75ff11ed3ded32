"""Line-first quality rules, native.

Every line of a text is judged by punctuation, navigation and boilerplate
rules; failing lines are removed, and a document that loses too large a share
of its characters is rejected. Everything is one map over the documents: no
shuffle, no Python.

Defined cases: a null or empty text has no words, fails the base rules and is
not kept; blank lines are neither judged nor counted as lost; repeated rows are
judged one by one; a text of any length is judged whole; an empty table gives an
empty table; extra columns are ignored by the query and carried by
clean_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, need, whole, words

#: A line is boilerplate if it has one of these (lower case): English, German, French, Spanish.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "copyright", "terms of use",
    "terms of service", "privacy policy", "cookie", "click here", "sign up", "subscribe",
    "javascript", "powered by", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "hier klicken", "abonnieren", "lizenziert unter",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "cliquez ici", "s'abonner", "sous licence",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "haga clic aquí", "suscríbete", "bajo licencia",
)
#: Marks that a line of prose may end with.
ENDINGS = ".!?:;…\"'”’»)]"
#: Marks that separate the entries of navigation lines.
SEPARATORS = "|»›•"

#: A line of so many words may end without such a mark: prose that was cut off, no heading or menu.
CUT_WORDS = 30

#: A word of a line, as elsewhere.
WORD = r"[^ \t-\r]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def _measured(line: Column) -> Column:
    """What the rules ask of a line, each measure taken once."""
    length = F.length(line)
    stripped = F.rtrim(F.translate(line, "\t\r\x0b\x0c", "    "))
    return F.struct(
        line.alias("line"), length.alias("n"), F.lower(line).alias("low"), F.right(stripped, F.lit(1)).alias("end"),
        (length - F.length(F.translate(line, "#*$%&|<>", ""))).alias("symbols"), (length - F.length(F.translate(line, "!", ""))).alias("shouts"),
        (length - F.length(F.translate(line, SEPARATORS, ""))).alias("separators"), F.regexp_count(line, F.lit(WORD + "+")).alias("words"),
    )


def _line_rules(line: Column, max_symbol_share: float, max_shout_share: float) -> dict[str, Column]:
    """Each rule's verdict on a measured line: true if the line fails."""
    ended = F.instr(F.lit(ENDINGS), line["end"]) > 0
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | F.contains(line["low"], F.lit(phrase))
    return {
        "punctuation": (~ended & (line["words"] < CUT_WORDS)) | (line["symbols"] > max_symbol_share * line["n"]) | (line["shouts"] > max_shout_share * line["words"]),
        "navigation": line["separators"] >= 2,
        "boilerplate": boilerplate,
    }


def with_rules(
    docs: DataFrame, max_lost_share: float = 0.5, max_symbol_share: float = 0.1, max_shout_share: float = 0.5
) -> DataFrame:
    """docs with a `text` column, plus clean_text, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_lines, n_bad_lines, lost_share, kept."""
    text = whole(F.col("text"))
    lines = F.split(text, "\n")
    d = docs.withColumns({"_words": words(F.col("text")), "_lines": F.transform(lines, _measured)})

    bad = lambda x: (lambda r: r["punctuation"] | r["navigation"] | r["boilerplate"])(
        _line_rules(x, max_symbol_share, max_shout_share)
    )
    worded = F.transform(F.filter(F.col("_lines"), lambda x: x["words"] > 0), lambda x: x["line"])
    w = F.col("_words")
    n_windows = F.size(w) - (WINDOW - 1)
    hashes = F.when(
        n_windows > 0,
        F.transform(F.sequence(F.lit(0), n_windows - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumns(
        {
            "_hashes": hashes,
            "_worded": worded,
            "_good": F.filter(F.col("_lines"), lambda x: (x["words"] == 0) | ~bad(x)),
        }
    )
    # Only texts in which some window comes twice need the windows' places.
    repeated = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    d = d.withColumn(
        "_sorted",
        F.when(repeated, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    s = F.col("_sorted")
    twin = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_places", F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"])))
    p = F.col("_places")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    n_chars = lambda of: F.aggregate(of, F.lit(0), lambda a, x: a + F.when(x["words"] > 0, x["n"]).otherwise(0))
    total, good = n_chars("_lines"), n_chars("_good")
    d = d.withColumns(
        {
            "clean_text": F.array_join(F.transform("_good", lambda x: x["line"]), "\n"),
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_lines": F.size("_worded").cast("long"),
            "n_bad_lines": (F.size("_lines") - F.size("_good")).cast("long"),
            "_total": total,
            "_kept_chars": good,
        }
    )
    d = d.withColumn(
        "lost_share",
        F.when(F.col("_total") > 0, (F.col("_total") - F.col("_kept_chars")) / F.col("_total")).otherwise(F.lit(0.0)),
    )
    d = d.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= F.lit(max_lost_share)))
    return d.drop("_words", "_lines", "_hashes", "_worded", "_good", "_sorted", "_places", "_total", "_kept_chars")


def clean_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with the columns of docs; text holds what the line rules leave."""
    safe, names = carried(docs, "text")
    # A filter would be pushed below and work out every rule again for each use; exploding one row or none is not.
    stay = F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    out = with_rules(safe, **options).withColumn("_stay", F.explode(stay)).withColumn("text", F.col("clean_text"))
    return out.select(*names).toDF(*docs.columns)


def quality_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: the base counts and both verdicts."""
    return with_rules(need(docs, "doc_id", "text"), **options).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_bad_lines",
    )


#: The same in DuckDB: windows are compared as lists of words, not hashes.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT r, i, ws[i:i+4] AS g FROM w, unnest(generate_series(1, len(ws) - 4)) AS u(i) WHERE len(ws) >= 5),
dup AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0,1,2,3,4]) AS k) GROUP BY r),
ln AS (SELECT r, j, ls[j] AS x, regexp_matches(ls[j], '[^ \t-\r]') AS has FROM w, unnest(generate_series(1, len(ls))) AS u(j)),
lf AS (
  SELECT r, x, has, length(x) AS n, rtrim(translate(x, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ') AS s,
    length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS sy,
    length(regexp_replace(x, '[^!]', '', 'g')) AS sh, length(regexp_replace(x, '[^|»›•]', '', 'g')) AS sp,
    len(list_filter(regexp_split_to_array(x, '[ \t-\r]+'), lambda y: y <> '')) AS nw FROM ln),
lv AS (
  SELECT r, x, has, n,
    (NOT (regexp_matches(s, '[.!?:;…"''”’»)\]]$')) AND nw < CUT_WORDS) OR sy > 0.1 * n OR sh > 0.5 * nw OR sp >= 2
    OR regexp_matches(lower(x), 'BOILER') AS bad FROM lf),
la AS (
  SELECT r, count(*) FILTER (has) AS n_lines, count(DISTINCT x) FILTER (has) AS u, count(*) FILTER (has AND bad) AS n_bad,
    coalesce(sum(n) FILTER (has), 0) AS total, coalesce(sum(n) FILTER (has AND bad), 0) AS lost FROM lv GROUP BY r),
b AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (n_lines - u)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines, n_bad::BIGINT AS n_bad_lines,
    CASE WHEN total > 0 THEN lost / total ELSE 0 END AS share
  FROM d JOIN w USING (r) JOIN la USING (r) LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND share <= 0.5 AS kept, n_lines, n_bad_lines FROM b
""".replace("BOILER", "|".join(BOILERPLATE).replace("'", "''")).replace("CUT_WORDS", str(CUT_WORDS))
