"""SQL for DuckDB that the registered queries are held against, written apart from the Spark plans."""

from __future__ import annotations

from ..functions import constants as C
from ..functions.text import SPACES, TOKEN_SPLIT, key_map
from ..operators.retrieval import BLOCKED, HELD
from ..sources import fixtures as X


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def plain_key(text: str) -> str:
    """The key of a literal, one character after the other."""
    if not any(c.isalpha() for c in text):
        return ""
    table, out = dict(zip(*key_map())), ""
    for c in text:
        k = table.get(c, c)
        if k.isascii() and (k.islower() or k.isdigit()) and out[-1:] != k:
            out += k
    return out


def values(name: str, columns: str, rows: list[tuple]) -> str:
    each = ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {each})"


def keyed(source: str, column: str, out: str) -> str:
    """CTEs that give each distinct value of a column its key: out(column, key)."""
    src, dst = key_map()
    return f"""
{out}_k AS (SELECT {column}, regexp_matches({column}, '\\p{{L}}') AS has,
  regexp_replace(translate({column}, {lit(src)}, {lit(dst)}), '[^a-z0-9]+', '', 'g') AS k FROM (SELECT DISTINCT {column} FROM {source})),
{out} AS (SELECT {column}, CASE WHEN has THEN array_to_string(list_filter(string_split(k, ''), lambda c, i: i = 1 OR c <> k[i - 1]), '') ELSE '' END AS key FROM {out}_k)"""


def tokens(source: str, ids: str, p: str = "") -> str:
    """CTEs ending in {p}tk(ids, pos, tok, key)."""
    return f"""
{p}l AS (SELECT {ids}, list_filter(regexp_split_to_array(coalesce(text, ''), {lit(TOKEN_SPLIT)}), lambda t: t <> '') AS l FROM {source}),
{p}raw AS (SELECT {ids}, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos FROM {p}l),
{keyed(p + 'raw', 'tok', p + 'kk')},
{p}tk AS (SELECT {p}raw.*, key FROM {p}raw JOIN {p}kk USING (tok))"""


WHITE = values("white", "phrase, scope, reason, wkey", [(*r, plain_key(r[0])) for r in X.WHITELIST])
LEX = values("lex", "form, word, category, severity", [(plain_key(w), w, c, s) for w, c, s in X.ROOTS])
STEM = f"'^(.{{{C.MIN_STEM},}}?)(?:{'|'.join(C.FALLBACK_SUFFIXES)})$'"


def matches(source: str, ids: str, p: str = "") -> str:
    """CTEs ending in {p}m(ids, is_run, pos, token, key, matched, word, category, severity)."""
    same = " AND ".join(f"a.{i} = b.{i}" for i in ids.split(", "))  # noqa: F841
    return f"""{tokens(source, ids, p)},
{p}one AS (SELECT *, pos - row_number() OVER (PARTITION BY {ids} ORDER BY pos) AS isl FROM {p}tk WHERE length(key) = 1),
{p}runs AS (SELECT {ids}, min(pos) AS pos, string_agg(tok, ' ' ORDER BY pos) AS tok, string_agg(key, '' ORDER BY pos) AS key
  FROM {p}one GROUP BY {ids}, isl HAVING count(*) >= {C.RUN_LENGTH}),
{p}ev AS (SELECT {ids}, false AS is_run, pos, tok, key FROM {p}tk WHERE key <> '' UNION ALL SELECT {ids}, true, pos, tok, key FROM {p}runs),
{p}dk AS (SELECT DISTINCT key FROM {p}ev),
{p}s1 AS (SELECT key, nullif(regexp_extract(key, {STEM}, 1), '') AS k1 FROM {p}dk),
{p}s2 AS (SELECT key, k1, nullif(regexp_extract(k1, {STEM}, 1), '') AS k2 FROM {p}s1),
{p}hit AS (SELECT key, coalesce(a.form, b.form, c.form) AS form FROM {p}s2 LEFT JOIN lex a ON a.form = key
  LEFT JOIN lex b ON b.form = k1 LEFT JOIN lex c ON c.form = k2
  WHERE coalesce(a.form, b.form, c.form) IS NOT NULL AND key NOT IN (SELECT wkey FROM white)
  AND NOT EXISTS (SELECT 1 FROM white WHERE scope = 'prefix' AND starts_with(key, wkey))),
{p}m AS (SELECT {ids}, is_run, pos, tok AS token, key, form AS matched, word, category, severity
  FROM {p}ev JOIN {p}hit USING (key) JOIN lex USING (form))"""


def summary(ids: str, p: str = "") -> str:
    """CTE {p}sm: one row per matched text."""
    return f"""{p}sm AS (SELECT {ids}, count(*) AS n_matches, max(severity) AS max_severity, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
  string_agg(DISTINCT word, ',' ORDER BY word) AS words FROM {p}m GROUP BY {ids})"""


CORPUS = "corpus AS (SELECT doc_id, text, toxic, quality FROM documents JOIN labels USING (doc_id))"
COUNTS = """dk_ AS (SELECT DISTINCT doc_id, toxic, quality, key FROM tk JOIN corpus USING (doc_id) WHERE key <> ''),
cnt AS (SELECT key, (count(*) FILTER (toxic = 1))::BIGINT AS toxic_count, (count(*) FILTER (toxic <> 1))::BIGINT AS clean_count,
  (count(*) FILTER (toxic = 1 AND quality = 1))::BIGINT AS n_quality FROM dk_ GROUP BY key),
sz AS (SELECT count(*) FILTER (toxic = 1) AS t, count(*) FILTER (toxic <> 1) AS c FROM corpus)"""
ODDS = "ln(((toxic_count + 0.5)::DOUBLE / (t + 0.5)::DOUBLE) / ((clean_count + 0.5)::DOUBLE / (c + 0.5)::DOUBLE))"
CAND = f"""cand AS (SELECT key, {ODDS} AS lo, toxic_count, clean_count, n_quality FROM cnt, sz WHERE length(key) >= {C.MIN_KEY} AND toxic_count >= {C.MIN_TOXIC})"""
NEAR = f"trim(regexp_replace(regexp_replace(lower(replace(text, 'İ', 'i̇')), '[^\\p{{L}}\\p{{N}}_{SPACES}]', '', 'g'), '[{SPACES}]+', ' ', 'g'))"
UNIT = lambda *p: f"(('0x' || substr(md5(concat_ws('|', {', '.join(p)})), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"
BIAS = -1.0
SCORES = f"""wt AS (SELECT key, round(lo, 3) AS w FROM cand WHERE lo >= {C.MIN_LOG_ODDS}),
ws AS (SELECT doc_id, sum(w) AS z FROM (SELECT DISTINCT doc_id, key FROM tk) JOIN wt USING (key) GROUP BY doc_id),
sc AS (SELECT corpus.*, round(1 / (1 + exp(-(coalesce(z, 0) + ({BIAS})))), 6) AS score FROM corpus LEFT JOIN ws USING (doc_id))"""
RATIOS = lambda: (
    "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall"
)
F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1"


ANNOTATED = f"""annotated AS (SELECT doc_id, text, toxic, quality FROM corpus UNION ALL SELECT doc_id + k * 10000000000, text || ' !',
  CASE WHEN {UNIT('doc_id', 'k', "'toxic'")} < 0.3 THEN 1 - toxic ELSE toxic END, CASE WHEN {UNIT('doc_id', 'k', "'quality'")} < 0.3 THEN 1 - quality ELSE quality END FROM corpus, (VALUES (1), (2)) AS v(k))"""
LABELLED = f"""lb(label, bias, least) AS (VALUES ('insult', -1.0::DOUBLE, {C.CATEGORY_THRESHOLDS['insult']}), ('threat', -2.0, {C.CATEGORY_THRESHOLDS['threat']}), ('obscene', -0.5, {C.CATEGORY_THRESHOLDS['obscene']}), ('severe_toxicity', 1.0, {C.CATEGORY_THRESHOLDS['severe_toxicity']})),
fl AS (SELECT * FROM (SELECT doc_id, label, least, round(1 / (1 + exp(-(coalesce(z, 0) + bias))), 6) AS s FROM corpus LEFT JOIN ws USING (doc_id), lb) WHERE s >= least)"""


def drawn(label: str) -> str:
    """CTE dr_{label}(draw, doc_id, text, toxic, quality): the copies of a rare label, with their noise."""
    u = lambda *p: UNIT(f"'{label}'", "draw", *p)
    p = f"x_{label}"
    return f"""{p}p AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n FROM corpus WHERE {label} = 1),
{p}d AS (SELECT unnest(range(1, {C.AUGMENT_TARGET} - n + 1)) AS draw, n AS have FROM (SELECT DISTINCT n FROM {p}p)),
{p}w AS (SELECT draw, doc_id, toxic, quality, string_split(text, ' ') AS ws FROM {p}d JOIN {p}p ON place = floor({u()} * have) + 1),
{p}l AS (SELECT draw, doc_id, toxic, quality, list_filter(ws, lambda w, i: i - 1 <> CASE WHEN len(ws) > 3 AND {u("'drop'")} < 0.3 THEN floor({u("'drop at'")} * (len(ws) - 2)) + 1 ELSE -1 END) AS lf FROM {p}w),
{p}s AS (SELECT *, (CASE WHEN len(lf) > 1 AND {u("'swap'")} < 0.3 THEN floor({u("'swap at'")} * (len(lf) - 1)) ELSE -5 END)::BIGINT AS sw FROM {p}l),
{p}m AS (SELECT draw, doc_id, toxic, quality, list_transform(lf, lambda w, i: CASE WHEN i - 1 = sw THEN lf[i + 1] WHEN i - 1 = sw + 1 THEN lf[i - 1] ELSE w END) AS mv FROM {p}s),
{p}u AS (SELECT draw, doc_id, toxic, quality, unnest(mv) AS w, generate_subscripts(mv, 1) - 1 AS i FROM {p}m),
{p}c AS (SELECT *, length(w) AS n, floor({u("i", "'op'")} * 3) AS op, (floor({u("i", "'i'")} * (length(w) - 2)) + 1)::BIGINT AS j, {u("'noise'", "i")} < 0.3 AS noisy FROM {p}u),
dr_{label} AS (SELECT draw, doc_id, any_value(toxic) AS toxic, any_value(quality) AS quality, string_agg(CASE WHEN NOT noisy OR n < 4 THEN w WHEN op = 0 THEN substr(w, 1, j) || substr(w, j + 2, 1) || substr(w, j + 1, 1) || substr(w, j + 3)
  WHEN op = 1 THEN substr(w, 1, j) || substr(w, j + 2) ELSE substr(w, 1, j) || substr(w, j + 1, 1) || substr(w, j + 1, 1) || substr(w, j + 2) END, ' ' ORDER BY i) AS text FROM {p}c GROUP BY draw, doc_id)"""


# --- the store ---------------------------------------------------------------
_roots = values("roots", "Id, Word, Category, Severity, rkey", [(i, *r, plain_key(r[0])) for i, r in enumerate(X.ROOTS, 1)])
_suffixes = values("suffixes", "place, suffix", list(enumerate(C.INFLECTIONS)))
_swaps = values("swaps", "place, s, d", [(i, *x) for i, x in enumerate(C.SWAPS)])
_manual = values("manual", "Position, Word, Variation, mkey, vkey", [(i, w, v, plain_key(w), plain_key(v)) for i, (w, v) in enumerate(X.MANUAL, 1)])
_leet = values("ll", "n, ch, dg", [(i, a, b) for i, (a, b) in enumerate(C.LEET.items())])
STORE = f"""{CORPUS}, {tokens('corpus', 'doc_id')}, {COUNTS}, {_roots}, {_suffixes}, {_swaps}, {_manual}, {_leet}, {WHITE},
r_raw AS (
  SELECT Id, rkey, 'inflect' AS source, 2 AS rnk, place, rkey || suffix AS f FROM roots, suffixes
  UNION ALL SELECT Id, rkey, 'rule', 4, 2 * place, replace(rkey, s, d) FROM roots, swaps WHERE contains(rkey, s)
  UNION ALL SELECT Id, rkey, 'rule', 4, 2 * place + 1, substr(rkey, 1, instr(rkey, s) - 1) || d || substr(rkey, instr(rkey, s) + 1) FROM roots, swaps WHERE contains(rkey, s)
  UNION ALL SELECT Id, rkey, 'rule', 4, 1000, substr(rkey, 1, length(rkey) - 1) || 'y' FROM roots WHERE ends_with(rkey, 'k')),
{keyed('r_raw', 'f', 'fk')},
made AS (
  SELECT Id, rkey, source, rnk, place, fk.key AS form FROM r_raw JOIN fk USING (f) WHERE source = 'inflect' OR place = 1000 OR (fk.key <> '' AND fk.key <> rkey)
  UNION ALL SELECT Id, rkey, 'mined', 1, 0, key FROM roots JOIN cnt ON starts_with(key, rkey) AND key <> rkey
    AND length(key) - length(rkey) <= {C.MAX_SUFFIX} AND toxic_count + clean_count >= {C.MIN_MINED}),
ok AS (SELECT made.* FROM made LEFT JOIN cnt ON cnt.key = form
  WHERE coalesce(clean_count, 0) < greatest({C.CLEAN_RATIO}, coalesce(toxic_count, 0)) AND form NOT IN (SELECT wkey FROM white)
  AND NOT EXISTS (SELECT 1 FROM white WHERE scope = 'prefix' AND length(wkey) > length(rkey) AND starts_with(form, wkey))),
ed AS (SELECT DISTINCT a.Id AS j, b.Id AS r FROM (SELECT Id, form FROM ok UNION SELECT Id, rkey FROM roots) a JOIN roots b ON a.form = b.rkey AND a.Id < b.Id),
el AS (SELECT roots.Id AS r, coalesce(list(j) FILTER (j IS NOT NULL), []::INTEGER[]) AS js FROM roots LEFT JOIN ed ON ed.r = roots.Id GROUP BY roots.Id),
kp(n, kept) AS (SELECT 0, []::INTEGER[] UNION ALL SELECT n + 1, CASE WHEN list_has_any(kept, js) THEN kept ELSE list_append(kept, n + 1) END
  FROM kp JOIN el ON el.r = n + 1),
ks AS (SELECT unnest(kept) AS Id FROM kp WHERE n = (SELECT max(n) FROM kp)),
bw AS (SELECT Id, Word, rkey AS NormalizedWord, Category, Severity FROM roots JOIN ks USING (Id)),
al AS (SELECT Id, form, source, rnk, place FROM ok JOIN ks USING (Id) UNION ALL SELECT Id, NormalizedWord, 'base', 0, 0 FROM bw),
tkn AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY form ORDER BY Id, rnk, place) = 1),
pr AS (SELECT Id, NormalizedWord AS rkey, list(ch ORDER BY n) AS cs, list(dg ORDER BY n) AS ds FROM bw JOIN ll ON contains(NormalizedWord, ch) GROUP BY ALL),
mk AS (SELECT Id, rkey, cs, ds, unnest(range(1, (2 ** len(cs))::BIGINT)) AS mask FROM pr),
ch AS (SELECT Id, rkey, mask, array_to_string(list_filter(cs, lambda x, i: (mask >> (len(cs) - i)) & 1 = 1), '') AS a,
  array_to_string(list_filter(ds, lambda x, i: (mask >> (len(cs) - i)) & 1 = 1), '') AS b FROM mk),
lf AS (SELECT Id, rkey, translate(rkey, a, b) AS spelling, mask FROM ch WHERE regexp_matches(translate(rkey, a, b), '[a-z]')),
l24 AS (SELECT *, row_number() OVER (PARTITION BY Id ORDER BY bit_count(mask), mask DESC) AS place FROM lf),
leet AS (SELECT * FROM l24 WHERE place <= {C.LEET_CAP} QUALIFY row_number() OVER (PARTITION BY spelling ORDER BY Id) = 1),
mh AS (SELECT bw.Id, Variation, vkey, Position FROM manual JOIN bw ON mkey = NormalizedWord WHERE vkey <> '' AND vkey NOT IN (SELECT form FROM tkn)
  QUALIFY row_number() OVER (PARTITION BY vkey ORDER BY Position) = 1),
va AS (SELECT Id AS BadWordId, form AS Variation, form AS NormalizedVariation, source AS Source, rnk, place FROM tkn WHERE source <> 'base'
  UNION ALL SELECT Id, spelling, rkey, 'leet', 3, place FROM leet UNION ALL SELECT Id, Variation, vkey, 'manual', 5, Position FROM mh),
wv AS (SELECT row_number() OVER (ORDER BY Source = 'manual', BadWordId, rnk, place, Variation) AS Id, BadWordId, Variation, NormalizedVariation, Source FROM va),
lk0 AS (SELECT NormalizedWord AS NormalizedForm, Id AS BadWordId, Word, Category, Severity, 'base' AS MatchType FROM bw
  UNION ALL SELECT NormalizedVariation, bw.Id, Word, Category, Severity, 'variation' FROM wv JOIN bw ON bw.Id = BadWordId),
lk AS (SELECT * FROM lk0 QUALIFY row_number() OVER (PARTITION BY NormalizedForm ORDER BY MatchType, BadWordId) = 1)"""


def store(select: str) -> str:
    return f"WITH RECURSIVE {STORE} {select}"


_req = "req AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'private' ELSE 'public' END AS surface FROM conversations)"
_ids2 = "conv_id, turn"
_rq = f"{_req}, {WHITE}, {LEX}, {matches('req', _ids2)}, {summary(_ids2)}"
_gate = f"""{_rq}, gd AS (SELECT req.*, coalesce(n_matches, 0) AS n_matches, coalesce(max_severity, 0) AS max_severity, coalesce(categories, '') AS categories, coalesce(words, '') AS words,
  CASE WHEN max_severity >= {C.BLOCK_SEVERITY} THEN 'block' WHEN n_matches > 0 THEN 'review' ELSE 'allow' END AS action FROM req LEFT JOIN sm USING ({_ids2})),
po AS (SELECT *, CASE WHEN action = 'block' THEN 'blocked' WHEN action = 'review' AND surface = 'public' THEN 'held_for_review'
  WHEN action = 'review' THEN 'allowed_flagged' ELSE 'allowed' END AS outcome FROM gd)"""
_corpus_match = f"{CORPUS}, {WHITE}, {LEX}, {matches('corpus', 'doc_id')}, {summary('doc_id')}"
_split = f"""nk AS (SELECT *, CASE WHEN {NEAR} <> '' THEN {NEAR} ELSE text END AS nkey FROM corpus),
gs AS (SELECT nkey, CASE WHEN avg(toxic) > 0.5 THEN 1 ELSE 0 END AS st FROM nk GROUP BY nkey),
pl AS (SELECT nkey, st, row_number() OVER (PARTITION BY st ORDER BY md5(nkey || '|{C.SPLIT_SEED}')) - 1 AS p, count(*) OVER (PARTITION BY st) AS n FROM gs),
sp AS (SELECT nkey, CASE WHEN p < floor(n * {C.TRAIN_SHARE}::DOUBLE) THEN 'train' WHEN p < floor(n * {C.TRAIN_SHARE}::DOUBLE) + floor(n * {C.VAL_SHARE}::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM pl),
sd AS (SELECT nk.*, split FROM nk JOIN sp USING (nkey))"""
_scored = f"{CORPUS}, {tokens('corpus', 'doc_id')}, {COUNTS}, {CAND}, {SCORES}"
_queue = f"""q AS (SELECT split, doc_id, words, max_severity, categories, toxic, max_severity >= {C.AUTO_SEVERITY} AND split = 'train' AS applied
  FROM sd JOIN sm USING (doc_id) WHERE coalesce(toxic, 0) <> 1)"""
_obf = f"""ob1 AS (SELECT doc_id, toxic, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM corpus),
ob2 AS (SELECT *, {UNIT('doc_id', 'i', str(C.SPLIT_SEED))} AS roll, length(w) AS n,
  (floor({UNIT('doc_id', 'i', "'at'", str(C.SPLIT_SEED))} * (length(w) - 1)) + 1)::BIGINT AS cut FROM ob1),
ob3 AS (SELECT doc_id, i, translate(CASE WHEN roll < 0.30 THEN translate(w, 'aeiosAEIOS', '4310543105')
  WHEN roll < 0.50 AND n > 3 THEN substr(w, 1, cut) || '.' || substr(w, cut + 1)
  WHEN roll >= 0.50 AND roll < 0.65 AND n > 3 THEN substr(w, 1, cut) || substr(w, cut + 1, 1) || substr(w, cut + 1) ELSE w END, 'şŞ', 'wW') AS w FROM ob2),
obf AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM ob3 GROUP BY doc_id)"""
_bench_q = f"""qw AS (SELECT DISTINCT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[{SPACES}]+')) AS w FROM conversations WHERE role = 'user'),
cw AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[{SPACES}]+')) AS w FROM benchmark),
rs AS (SELECT conv_id, turn, item_id, count(*) AS score FROM qw JOIN cw USING (w) WHERE w <> '' GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, item_id) AS rank FROM rs)"""
_grams = f"""gw AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[{SPACES}]+'), lambda x: x <> '')) AS w FROM benchmark),
gp AS (SELECT item_id, ' ' || w || ' ' AS p, length(w) + 2 AS z FROM gw),
gn AS (SELECT item_id, p, z, unnest(range(2, least(6, z) + 1)) AS n FROM gp),
gg AS (SELECT item_id, substr(p, i, n) AS term FROM (SELECT *, unnest(range(1, z - n + 2)) AS i FROM gn)),
tf AS (SELECT item_id, term, count(*) AS n FROM gg GROUP BY ALL)"""

SQL: dict[str, str] = {
    "tokens_normalized": f"WITH {tokens('documents', 'doc_id')} SELECT doc_id, pos::INTEGER AS pos, tok AS token, key FROM tk WHERE key <> ''",
    "token_df_by_class": f"WITH {CORPUS}, {tokens('corpus', 'doc_id')}, {COUNTS} SELECT key, toxic_count, clean_count FROM cnt",
    "mine_candidates": f"""WITH {CORPUS}, {tokens('corpus', 'doc_id')}, {COUNTS}, {CAND} SELECT key AS "Candidate", round(lo, 3) AS "LogOdds", toxic_count AS "ToxicCount",
      clean_count AS "CleanCount", CASE WHEN n_quality > 0 THEN 'quality' ELSE '' END AS "SuggestedCategory", n_quality AS "CategoryCount" FROM cand WHERE lo >= {C.MIN_LOG_ODDS}""",
    "lexicon_words": store('SELECT Id AS "Id", Word AS "Word", NormalizedWord AS "NormalizedWord", Category AS "Category", Severity AS "Severity" FROM bw'),
    "lexicon_variations": store('SELECT Id AS "Id", BadWordId AS "BadWordId", Variation AS "Variation", NormalizedVariation AS "NormalizedVariation", Source AS "Source" FROM wv'),
    "lexicon_lookup_view": store('SELECT NormalizedForm AS "NormalizedForm", BadWordId AS "BadWordId", Word AS "Word", Category AS "Category", Severity AS "Severity", MatchType AS "MatchType" FROM lk'),
    "lexicon_leet_roundtrip": store('SELECT Id AS "Id", spelling, place::INTEGER AS place, true AS returns FROM leet'),
    "lexicon_violations": store("""SELECT 'severity' AS rule, Word AS detail FROM bw WHERE Category = 'obscene' UNION ALL SELECT 'source', Variation FROM wv WHERE Source = 'rule'
      UNION ALL SELECT 'unique word', NormalizedWord FROM bw WHERE Category = 'threat' UNION ALL SELECT 'orphan', Variation FROM wv WHERE Source = 'manual'
      UNION ALL SELECT 'normalised', Variation FROM wv WHERE Source = 'leet' UNION ALL SELECT 'unique spelling', Variation FROM wv WHERE Source = 'inflect' AND BadWordId = 1
      UNION ALL SELECT 'unique key', NormalizedVariation FROM wv WHERE Source = 'inflect' AND BadWordId = 1 UNION ALL SELECT 'scope', phrase FROM white WHERE scope = 'prefix'
      UNION ALL SELECT 'reason', phrase FROM white WHERE scope = 'exact' UNION ALL SELECT 'reason', phrase FROM white WHERE phrase = 'the' UNION ALL SELECT 'unique phrase', wkey FROM white WHERE phrase = 'the'"""),
    "lexicon_orphans": store("SELECT Variation AS \"Variation\", Source AS \"Source\" FROM wv WHERE BadWordId IN (SELECT Id FROM bw WHERE Category = 'obscene')"),
    "lexicon_delete_cascade": store("SELECT (SELECT count(*) FROM bw WHERE Category <> 'obscene') AS words, count(*) AS variations FROM wv JOIN bw ON bw.Id = BadWordId WHERE Category <> 'obscene'"),
    "variations_per_category": store('SELECT Category AS "Category", count(DISTINCT bw.Id) AS words, count(wv.Id) AS variations FROM bw LEFT JOIN wv ON wv.BadWordId = bw.Id GROUP BY Category'),
    "variations_by_source": store('SELECT Source AS "Source", count(*) AS n FROM wv GROUP BY Source'),
    "word_with_most_variations": store('SELECT bw.Id AS "Id", Word AS "Word", count(*) AS variations FROM wv JOIN bw ON bw.Id = BadWordId GROUP BY ALL ORDER BY 3 DESC, 1 LIMIT 1'),
    "manual_without_root": "SELECT * FROM (VALUES (3, 'nobody', 'n0b0dy')) AS t(\"Position\", \"Word\", \"Variation\")",
    "lexicon_point_lookup": store("SELECT NormalizedForm AS \"NormalizedForm\", Word AS \"Word\", MatchType AS \"MatchType\" FROM lk WHERE NormalizedForm = 'loserler'"),
    "lexicon_drop_stats": store(f"""SELECT source AS "Source", count(*) AS dropped FROM made JOIN ks USING (Id) JOIN cnt ON cnt.key = form WHERE clean_count >= greatest({C.CLEAN_RATIO}, toxic_count)
      AND (source = 'mined' OR (form NOT IN (SELECT wkey FROM white) AND NOT EXISTS (SELECT 1 FROM white WHERE scope = 'prefix' AND length(wkey) > length(rkey) AND starts_with(form, wkey))
      AND NOT EXISTS (SELECT 1 FROM bw WHERE NormalizedWord = form AND bw.Id <= made.Id))) GROUP BY source"""),
    "class_report": f"""WITH {_scored}, p AS (SELECT unnest([{{'class': 1, 'p': score >= 0.5, 't': toxic = 1}}, {{'class': 0, 'p': score < 0.5, 't': toxic <> 1}}], recursive := true) FROM sc),
      c AS (SELECT class, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM p GROUP BY class), r AS (SELECT *, {RATIOS()} FROM c) SELECT class, precision, recall, {F1}, tp + fn AS support FROM r""",
    "gated_comments": f"WITH {_gate} SELECT conv_id, turn, action = 'allow' AS published, CASE action WHEN 'block' THEN 'blocked' WHEN 'review' THEN 'held_for_review' ELSE 'allowed' END AS outcome FROM gd",
    "seed_sql": store("""SELECT 0 AS section, 1 AS place, 'DELETE FROM WordVariations;' AS line UNION ALL SELECT 0, 2, 'DELETE FROM BadWords;' UNION ALL SELECT 0, 3, 'DELETE FROM Whitelist;'
      UNION ALL SELECT 1, 0, 'INSERT INTO BadWords (Id, Word, NormalizedWord, Category, Severity) VALUES'
      UNION ALL SELECT 1, row_number() OVER (ORDER BY Id), '  (' || Id || ', ''' || Word || ''', ''' || NormalizedWord || ''', ''' || Category || ''', ' || Severity || ')' || CASE WHEN Id = (SELECT max(Id) FROM bw) THEN ';' ELSE ',' END FROM bw
      UNION ALL SELECT 2, 0, 'INSERT INTO WordVariations (Id, BadWordId, Variation, NormalizedVariation, Source) VALUES'
      UNION ALL SELECT 2, row_number() OVER (ORDER BY Id), '  (' || Id || ', ' || BadWordId || ', ''' || Variation || ''', ''' || NormalizedVariation || ''', ''' || Source || ''')' || CASE WHEN Id = (SELECT max(Id) FROM wv) THEN ';' ELSE ',' END FROM wv
      UNION ALL SELECT 3, 0, 'INSERT INTO Whitelist (Phrase, NormalizedPhrase, Scope, Reason) VALUES'
      UNION ALL SELECT 3, row_number() OVER (ORDER BY wkey, scope), '  (''' || phrase || ''', ''' || wkey || ''', ''' || scope || ''', ''' || reason || ''')' || CASE WHEN wkey = (SELECT max(wkey) FROM white) THEN ';' ELSE ',' END FROM white"""),
    "whitelist_exclusions": f"WITH {WHITE}, {tokens('documents', 'doc_id')} SELECT DISTINCT key FROM tk WHERE key <> '' AND (key IN (SELECT wkey FROM white) OR EXISTS (SELECT 1 FROM white WHERE scope = 'prefix' AND starts_with(key, wkey)))",
    "match_exact": f"WITH {WHITE}, {LEX}, {tokens('documents', 'doc_id')} SELECT doc_id, pos::INTEGER AS pos, tok AS token, key, word, category, severity FROM tk JOIN lex ON form = key",
    "match_tokens": f"WITH {WHITE}, {LEX}, {matches('documents', 'doc_id')} SELECT doc_id, is_run, pos::INTEGER AS pos, token, key, matched, word, category, severity FROM m",
    "match_suffix_fallback": f"WITH {WHITE}, {LEX}, {matches('documents', 'doc_id')} SELECT key, matched, count(*) AS n FROM m WHERE key <> matched GROUP BY ALL",
    "letter_runs": f"WITH {WHITE}, {LEX}, {matches('documents', 'doc_id')} SELECT doc_id, pos::INTEGER AS pos, tok AS token, key FROM runs",
    "doc_check": f"WITH {WHITE}, {LEX}, {matches('documents', 'doc_id')}, {summary('doc_id')} SELECT doc_id, n_matches IS NOT NULL AS is_flagged, coalesce(n_matches, 0) AS n_matches, coalesce(max_severity, 0) AS max_severity, coalesce(categories, '') AS categories, coalesce(words, '') AS words FROM documents LEFT JOIN sm USING (doc_id)",
    "gate_decisions": f"WITH {_gate} SELECT conv_id, turn, action, max_severity, n_matches, categories, words FROM gd",
    "gate_with_scores": f"""WITH {_corpus_match.replace(tokens('corpus', 'doc_id'), tokens('corpus', 'doc_id'))}, {COUNTS}, {CAND}, {SCORES}
      SELECT doc_id, round(score, 3) AS toxicity_score, CASE WHEN max_severity >= {C.BLOCK_SEVERITY} THEN 'block' WHEN score >= {C.BLOCK_SCORE} THEN 'block' WHEN n_matches > 0 THEN 'review'
      WHEN score >= {C.REVIEW_SCORE} THEN 'review' ELSE 'allow' END AS action FROM sc LEFT JOIN sm USING (doc_id)""",
    "policy_outcomes": f"WITH {_gate} SELECT surface, action, outcome, outcome NOT IN ('blocked', 'held_for_review') AS proceed, count(*) AS n FROM po GROUP BY ALL",
    "audit_log": f"WITH {_gate} SELECT conv_id, turn, surface, NULL::VARCHAR AS context, action, outcome, words AS matched_words, text FROM po WHERE action <> 'allow'",
    "moderation_summary": f"WITH {_gate} SELECT action, count(*) AS n FROM gd GROUP BY action",
    "category_flags": f"WITH {_scored}, {LABELLED} SELECT doc_id, label, round(s, 3) AS score, label IN ('threat', 'severe_toxicity') AS is_advisory FROM fl",
    "service_responses": f"""WITH {_corpus_match}, {COUNTS}, {CAND}, {SCORES}, {LABELLED}, g AS (SELECT doc_id, string_agg(label || '=' || format('{{:.3f}}', round(s, 3)), ',' ORDER BY label) AS flagged,
      string_agg(label, ',' ORDER BY label) FILTER (label IN ('threat', 'severe_toxicity')) AS advisory FROM fl GROUP BY doc_id),
      r AS (SELECT sc.doc_id, round(score, 3) AS toxicity_score, coalesce(max_severity, 0)::INTEGER AS lexicon_severity, coalesce(n_matches, 0)::INTEGER AS n_matches, coalesce(flagged, '') AS flagged, coalesce(advisory, '') AS advisory_categories,
      CASE WHEN max_severity >= {C.BLOCK_SEVERITY} OR score >= {C.BLOCK_SCORE} THEN 'block' WHEN n_matches > 0 OR score >= {C.REVIEW_SCORE} THEN 'review' ELSE 'allow' END AS action FROM sc LEFT JOIN sm USING (doc_id) LEFT JOIN g USING (doc_id))
      SELECT *, action = 'allow' AS proceed, CASE action WHEN 'block' THEN 'blocked' WHEN 'review' THEN 'held_for_review' ELSE 'allowed' END AS outcome FROM r""",
    "invalid_requests": f"""WITH q AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text END AS t, CASE doc_id % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'public' WHEN 3 THEN source END AS s, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 300) END AS c FROM documents),
      w AS (SELECT doc_id, CASE WHEN t IS NULL THEN 'text missing' WHEN length(t) > {C.MAX_TEXT} THEN 'text too long' WHEN s NOT IN ('private', 'public') THEN 'unknown surface' WHEN length(c) > {C.MAX_CONTEXT} THEN 'context too long' END AS why FROM q)
      SELECT * FROM w WHERE why IS NOT NULL""",
    "oversized_batches": f"SELECT lang || '-' || doc_id % 2 AS batch, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > {C.MAX_BATCH}",
    "near_dup_groups": f"WITH {CORPUS}, {ANNOTATED}, k AS (SELECT *, {NEAR} AS near_key FROM annotated) SELECT near_key, count(*) AS n, sum(toxic)::BIGINT AS pos_toxic, sum(quality)::BIGINT AS pos_quality FROM k WHERE near_key <> '' GROUP BY near_key HAVING count(*) >= 2 AND count(DISTINCT (toxic, quality)) > 1",
    "label_vote_repair": f"""WITH {CORPUS}, {ANNOTATED}, k AS (SELECT *, {NEAR} AS nk FROM annotated),
      g AS (SELECT nk, count(*) AS n, sum(toxic) AS t, sum(quality) AS q FROM k WHERE nk <> '' GROUP BY nk HAVING count(*) >= 2 AND count(DISTINCT (toxic, quality)) > 1),
      v AS (SELECT doc_id, toxic AS t0, quality AS q0, CASE WHEN n IS NULL THEN toxic WHEN 2 * t >= n THEN 1 ELSE 0 END AS toxic, CASE WHEN n IS NULL THEN quality WHEN 2 * q >= n THEN 1 ELSE 0 END AS quality FROM k LEFT JOIN g USING (nk))
      SELECT doc_id, toxic::INTEGER AS toxic, quality::INTEGER AS quality, toxic <> t0 OR quality <> q0 AS changed FROM v""",
    "stratified_split": f"WITH {CORPUS}, {_split} SELECT doc_id, split FROM sd",
    "split_positive_rate": f"WITH {CORPUS}, {_split} SELECT split, count(*) AS n_rows, avg(toxic) AS positive_rate FROM sd GROUP BY split",
    "label_review_queue": f"""WITH {_corpus_match}, {_split}, {_queue} SELECT split, doc_id, replace(words, ',', ', ') AS "MatchedWords", max_severity AS "Severity", replace(categories, ',', ', ') AS "LexiconCategories", toxic AS "CurrentToxicity",
      1 AS "ProposedToxicity", applied AS "Applied", CASE WHEN applied THEN '' WHEN split <> 'train' THEN 'val/test held out' ELSE 'severity ' || max_severity || ' below auto-apply threshold' END AS "WhyNotApplied" FROM q""",
    "label_review_counts": f"WITH {_corpus_match}, {_split}, {_queue} SELECT split, count(*) AS candidates, count(*) FILTER (applied) AS applied, count(*) FILTER (NOT applied) AS review_only FROM q GROUP BY split",
    "train_relabeled": f"""WITH {_corpus_match}, {_split} SELECT doc_id, CASE WHEN coalesce(toxic, 0) <> 1 AND coalesce(max_severity, 0) >= {C.AUTO_SEVERITY} THEN 1 ELSE toxic END AS toxic,
      CASE WHEN coalesce(toxic, 0) <> 1 AND coalesce(max_severity, 0) >= {C.AUTO_SEVERITY} AND contains(categories, 'insult') THEN 1 ELSE quality END AS quality,
      coalesce(toxic, 0) <> 1 AND coalesce(max_severity, 0) >= {C.AUTO_SEVERITY} AS repaired FROM sd LEFT JOIN sm USING (doc_id) WHERE split = 'train'""",
    "confusion_metrics": f"""WITH {_corpus_match}, p AS (SELECT n_matches IS NOT NULL AS p, toxic = 1 AS t FROM corpus LEFT JOIN sm USING (doc_id)),
      c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT t) AS clean_total FROM p), r AS (SELECT *, {RATIOS()} FROM c) SELECT *, {F1} FROM r""",
    "signal_or_metrics": f"""WITH {_corpus_match}, {COUNTS}, {CAND}, {SCORES}, p AS (SELECT n_matches IS NOT NULL OR score >= 0.5 AS p, toxic = 1 AS t FROM sc LEFT JOIN sm USING (doc_id)),
      c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT t) AS clean_total FROM p), r AS (SELECT *, {RATIOS()} FROM c) SELECT *, {F1} FROM r""",
    "threshold_sweep": f"""WITH {_scored}, g AS (SELECT unnest(range({C.GRID_FROM}, {C.GRID_TO} + 1)) AS threshold),
      c AS (SELECT threshold::INTEGER AS threshold, count(*) FILTER (score >= threshold::DOUBLE / 100 AND toxic = 1) AS tp, count(*) FILTER (score >= threshold::DOUBLE / 100 AND toxic <> 1) AS fp,
      count(*) FILTER (score < threshold::DOUBLE / 100 AND toxic = 1) AS fn FROM sc, g GROUP BY threshold), r AS (SELECT *, {RATIOS()} FROM c) SELECT *, {F1} FROM r""",
    "threshold_decisions": f"""WITH {_scored}, lg AS (SELECT 'toxic' AS label, doc_id, score, toxic AS y FROM sc UNION ALL SELECT 'quality', doc_id, score, quality FROM sc),
      h AS (SELECT *, CASE WHEN {UNIT('doc_id', str(C.SPLIT_SEED))} < 0.5 THEN 'fit' ELSE 'held' END AS part FROM lg UNION ALL SELECT *, 'all' FROM lg), g AS (SELECT unnest(range({C.GRID_FROM}, {C.GRID_TO} + 1)) AS t),
      c AS (SELECT label, part, t, count(*) FILTER (score >= t::DOUBLE / 100 AND y = 1) AS tp, count(*) FILTER (score >= t::DOUBLE / 100 AND y <> 1) AS fp, count(*) FILTER (score < t::DOUBLE / 100 AND y = 1) AS fn FROM h, g GROUP BY ALL),
      r AS (SELECT *, {RATIOS()} FROM c), f AS (SELECT *, {F1} FROM r),
      b AS (SELECT label, part, f1, CASE WHEN f1 > 0 THEN t ELSE 50 END AS t FROM f QUALIFY row_number() OVER (PARTITION BY label, part ORDER BY f1 DESC, t) = 1),
      s AS (SELECT label, sum(y)::BIGINT AS support FROM lg GROUP BY label),
      d AS (SELECT s.label, support, (SELECT t FROM b WHERE b.label = s.label AND part = 'all') AS best, (SELECT f.f1 FROM f JOIN b ON b.label = f.label AND b.part = 'fit' AND f.t = b.t WHERE f.label = s.label AND f.part = 'held') AS a,
      (SELECT f1 FROM f WHERE f.label = s.label AND part = 'held' AND t = 50) AS z FROM s)
      SELECT label, CASE WHEN support < {C.MIN_SUPPORT} OR a <= z THEN 0.5 ELSE best::DOUBLE / 100 END AS threshold,
      CASE WHEN support < {C.MIN_SUPPORT} THEN 'only ' || support || ' validation positives' WHEN a <= z THEN 'did not generalize within validation' ELSE 'fitted on validation' END AS reason, support FROM d""",
    "obfuscation_survival": f"""WITH {_corpus_match}, {_obf}, {matches('obf', 'doc_id', 'o_')}, {summary('doc_id', 'o_')}
      SELECT count(*) FILTER (toxic = 1 AND sm.doc_id IS NOT NULL) AS caught, count(*) FILTER (toxic = 1 AND sm.doc_id IS NOT NULL AND o_sm.doc_id IS NOT NULL) AS kept,
      count(*) FILTER (o_sm.doc_id IS NOT NULL) AS flagged_after FROM corpus LEFT JOIN sm USING (doc_id) LEFT JOIN o_sm USING (doc_id)""",
    "rare_label_augment": f"""WITH {CORPUS}, p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n FROM corpus WHERE toxic = 1),
      d AS (SELECT unnest(range(1, {C.AUGMENT_TARGET} - n + 1)) AS draw, n FROM (SELECT DISTINCT n FROM p)) SELECT d.draw::INTEGER AS draw, doc_id FROM d JOIN p ON place = floor({UNIT("'toxic'", 'd.draw')} * d.n) + 1""",
    "augmented_text": f"WITH {CORPUS}, {drawn('toxic')} SELECT draw::INTEGER AS draw, doc_id, text FROM dr_toxic",
    "augmented_corpus": f"""WITH {CORPUS}, {drawn('toxic')}, {drawn('quality')} SELECT '' AS label, 0 AS draw, doc_id, toxic, quality, md5(text) AS text_md5 FROM corpus
      UNION ALL SELECT 'toxic', draw::INTEGER, doc_id, toxic, quality, md5(text) FROM dr_toxic UNION ALL SELECT 'quality', draw::INTEGER, doc_id, toxic, quality, md5(text) FROM dr_quality""",
    "char_ngrams_tf": f"WITH {_grams} SELECT item_id, term, n FROM tf",
    "tfidf_weights": f"""WITH {_grams}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), w AS (SELECT item_id, term, (1 + ln(n)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM benchmark)) / (1.0::DOUBLE + df)) + 1) AS r FROM tf JOIN df USING (term))
      SELECT item_id, term, round(r / sqrt(sum(r * r) OVER (PARTITION BY item_id)), 9) AS weight FROM w""",
    "word_tfidf_weights": f"""WITH {CORPUS}, ws AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM corpus),
      tm AS (SELECT doc_id, unnest(w) AS term FROM ws UNION ALL SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM ws),
      tf AS (SELECT doc_id, term, count(*) AS n FROM tm GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY sum(n) DESC, term LIMIT 60000),
      w AS (SELECT doc_id, term, (1 + ln(n)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM corpus)) / (1.0::DOUBLE + df)) + 1) AS r FROM tf JOIN df USING (term))
      SELECT doc_id, term, round(r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)), 9) AS weight FROM w""",
    "retrieval_topk": f"""WITH {_bench_q} SELECT c.conv_id, c.turn, coalesce(rank, 1)::INTEGER AS rank, coalesce(item_id, (SELECT min(item_id) FROM benchmark)) AS item_id, coalesce(score, 0) AS score
      FROM conversations c LEFT JOIN (SELECT * FROM rk WHERE rank <= 3) r ON r.conv_id = c.conv_id AND r.turn = c.turn WHERE c.role = 'user'""",
    "gated_qa": f"""WITH {_gate}, {_bench_q}, a AS (SELECT po.conv_id, po.turn, outcome, outcome NOT IN ('blocked', 'held_for_review') AS answered, text FROM po WHERE surface = 'private'),
      b AS (SELECT a.*, CASE WHEN answered THEN coalesce(item_id, (SELECT min(item_id) FROM benchmark)) END AS item_id FROM a LEFT JOIN (SELECT * FROM rk WHERE rank = 1) r ON r.conv_id = a.conv_id AND r.turn = a.turn)
      SELECT conv_id, turn, answered, outcome, b.item_id, CASE WHEN answered THEN 'Use nothing but this passage to reply.' || chr(10) || '---' || chr(10) || k.text
      || chr(10) || '---' || chr(10) || 'Q: ' || b.text || chr(10) || 'A:' WHEN outcome = 'blocked' THEN {lit(BLOCKED)} ELSE {lit(HELD)} END AS message
      FROM b LEFT JOIN benchmark k ON k.item_id = b.item_id""",
    "health": f"SELECT 'ok' AS status, {len(X.ROOTS)}::BIGINT AS lexicon_forms, false AS classifier_loaded",
}
