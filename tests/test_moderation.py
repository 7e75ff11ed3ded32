import json

import pytest
from pyspark.sql import functions as F

from textward.functions import constants as C
from textward.operators import evaluation, features, gate, labels, lexicon, match, mining, retrieval
from textward.sources import sinks, tables
from textward.streaming import moderate


@pytest.fixture(scope="module")
def lex(spark):
    rows = [("kitab", 1, "Kitab", "insult", 3, "base"), ("sas", 2, "sas", "obscene", 2, "base"), ("qelem", 3, "qələm", "insult", 1, "base")]
    return spark.createDataFrame(rows, "NormalizedForm string, BadWordId int, Word string, Category string, Severity int, MatchType string")


@pytest.fixture(scope="module")
def white(spark):
    return lexicon.build_whitelist(spark.createDataFrame([("kitabxana", "prefix", "library"), ("sasa", "exact", "name")], "Phrase string, Scope string, Reason string"))


def found(spark, lex, white, text, **options):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return sorted((r["token"], r["matched"]) for r in match.scan(df, ["id"], lex, white, **options).collect())


@pytest.mark.parametrize(
    "text, expected",
    [
        ("bir k1t4b var", [("k1t4b", "kitab")]), ("k i t a b", [("k i t a b", "kitab")]), ("KİTABLAR", [("KİTABLAR", "kitab")]),
        ("kitablarin", [("kitablarin", "kitab")]), ("kitab kitab", [("kitab", "kitab")] * 2), ("кitab", [("кitab", "kitab")]),
        ("kitabxanada", []), ("sasa", []), ("sakit", []), ("", []), (None, []), ("k i 1 t a b", []), ("k!tab", []), ("s a s", [("s a s", "sas")]),
    ],
)
def test_scan(spark, lex, white, text, expected):
    assert found(spark, lex, white, text) == sorted(expected)


def test_check_stem(spark, lex):
    white = lexicon.build_whitelist(spark.createDataFrame([("sas", "exact", "x")], "Phrase string, Scope string, Reason string"))
    assert found(spark, lex, white, "saslar") == [("saslar", "sas")]
    assert found(spark, lex, white, "saslar", check_stem=True) == []


def test_whitelist_is_checked(spark):
    bad = spark.createDataFrame([("a", "some", "r")], "Phrase string, Scope string, Reason string")
    with pytest.raises(Exception, match="bad Scope"):
        lexicon.build_whitelist(bad).collect()


def test_gate_table(spark, lex, white):
    rows = [(1, "kitab", 0.01), (2, "x", 0.99), (3, "x", 0.8), (4, "x", 0.05), (5, None, None), (6, "sas", 0.1), (7, "x", 0.97), (8, "x", 0.5)]
    df = spark.createDataFrame(rows, "id int, text string, toxicity_score double")
    out = gate.decide(match.check(df, ["id"], lex, white))
    assert {r["id"]: r["action"] for r in out.collect()} == {1: "block", 2: "block", 3: "review", 4: "allow", 5: "allow", 6: "review", 7: "block", 8: "review"}
    assert out.where("id = 1").first()["reason"] == "lexicon severity 3: Kitab"


def test_policy(spark):
    df = spark.createDataFrame([(a, s) for a in ("block", "review", "allow") for s in ("private", "public")], "action string, surface string")
    got = {(r["action"], r["surface"]): (r["proceed"], r["outcome"]) for r in gate.apply_policy(df).collect()}
    assert got == {
        ("block", "private"): (False, "blocked"), ("block", "public"): (False, "blocked"), ("review", "private"): (True, "allowed_flagged"),
        ("review", "public"): (False, "held_for_review"), ("allow", "private"): (True, "allowed"), ("allow", "public"): (True, "allowed"),
    }


def test_categories(spark):
    rows = [(1, label, t + d) for label, t in C.CATEGORY_THRESHOLDS.items() for d in (0.05,)] + [(2, label, t - 0.05) for label, t in C.CATEGORY_THRESHOLDS.items()]
    flagged = gate.flag_categories(spark.createDataFrame(rows, "id int, label string, score double"), ["id"])
    maps = {r["id"]: r for r in gate.category_maps(flagged, ["id"]).collect()}
    assert set(maps) == {1} and "toxicity" not in maps[1]["flagged_categories"] and maps[1]["advisory_categories"] == ["severe_toxicity", "threat"]


def test_requests(spark):
    rows = [("1", "ok", None, None), ("2", "x" * 10_001, "public", None), ("3", "ok", "secret", None), ("4", None, "public", None), ("5", "ok", "private", "c" * 201)]
    df = spark.createDataFrame(rows, tables.REQUEST)
    good, bad = gate.split_requests(df)
    assert [tuple(r)[:3] for r in good.select("request_id", "text", "surface").collect()] == [("1", "ok", "public")]
    assert {r["request_id"]: r["why"] for r in bad.collect()} == {"2": "text too long", "3": "unknown surface", "4": "text missing", "5": "context too long"}
    batches = spark.range(101).withColumn("b", F.lit("x")).union(spark.range(100).withColumn("b", F.lit("y")))
    assert [r["b"] for r in gate.oversized_batches(batches, "b").collect()] == ["x"]


def test_audit_log(spark, lex, white, tmp_path):
    df = spark.createDataFrame([("1", "kitab sas", "public", "comment:1"), ("2", "salam", "public", None)], tables.REQUEST)
    answered, _ = moderate.answer(df, lex, white)
    sinks.append_audit(gate.audit(answered), str(tmp_path / "log"))
    lines = [json.loads(x) for p in (tmp_path / "log").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 1 and lines[0]["matched_words"] == ["Kitab", "sas"] and lines[0]["context"] == "comment:1"
    sinks.append_audit(gate.audit(answered), "nosuch://x/log")  # a warning, no error


def test_stream(spark, lex, white, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"request_id":"1","text":"kitab","surface":"public"}\n{"request_id":"2","text":"salam","surface":"private"}\n{"request_id":"3","surface":"public"}\n')
    q = moderate.start(tables.request_stream(spark, str(tmp_path / "in")), lex, white, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {n: spark.read.json(str(tmp_path / "out" / n)).count() for n in ("content", "audit", "rejected")}
    assert got == {"content": 1, "audit": 1, "rejected": 1}


@pytest.fixture(scope="module")
def built(spark):
    roots = spark.createDataFrame([(1, "loser", "insult", 2), (2, "losersiz", "insult", 1), (3, "gek", "obscene", 3), (4, "Gek", "obscene", 1)], "Id int, Word string, Category string, Severity int")
    manual = spark.createDataFrame([(1, "gek", "geçx"), (2, "none", "abc"), (3, "gek", "gekler")], "Position int, Word string, Variation string")
    white = lexicon.build_whitelist(spark.createDataFrame([("loserin", "exact", "x")], "Phrase string, Scope string, Reason string"))
    counts = spark.createDataFrame([("loserhed", 3, 0), ("losermart", 1, 4), ("loserly", 1, 0), ("gekda", 0, 2)], "key string, toxic_count long, clean_count long")
    return (*lexicon.build(roots, manual, white, counts), white, roots, manual, counts)


def test_build(built):
    words, variations, white, roots, manual, counts = built
    assert sorted(r["Id"] for r in words.collect()) == [1, 3]  # 2 is an inflection of 1, 4 has the key of 3
    by = {(r["BadWordId"], r["Source"], r["NormalizedVariation"]) for r in variations.collect()}
    assert (1, "mined", "loserhed") in by and (1, "inflect", "losersiz") in by and (3, "manual", "gecx") in by
    forms = {x[2] for x in by}
    assert not forms & {"losermart", "loserly", "loserin", "gekda"}  # clean, rare, whitelisted, clean
    assert ("manual", "gekler") not in {(x[1], x[2]) for x in by} and (3, "rule", "gey") in by
    assert [r["Word"] for r in lexicon.unmatched_manual(roots, manual).collect()] == ["none"]
    assert lexicon.violations(words, variations, white).count() == 0
    assert sorted(r["Id"] for r in variations.collect()) == list(range(1, variations.count() + 1))


def test_greedy_build_agrees(built):
    """The claims in rank order against the same rules as one loop."""
    from tests.test_text import slow_key

    words, variations, white, roots, manual, counts = built
    count = {r["key"]: (r["toxic_count"], r["clean_count"]) for r in counts.collect()}
    taken, got = set(), {}
    for r in sorted(roots.collect()):
        root = slow_key(r["Word"])
        if root in taken:
            continue
        taken.add(root)
        forms = [("mined", k) for k, (t, c) in sorted(count.items()) if k != root and k.startswith(root) and len(k) - len(root) <= 7 and t + c >= 2]
        forms += [("inflect", slow_key(root + s)) for s in C.INFLECTIONS]
        for s, d in C.SWAPS:
            forms += [("rule", f) for f in (slow_key(root.replace(s, d)), slow_key(root.replace(s, d, 1))) if s in root and f != root]
        forms += [("rule", slow_key(root[:-1] + "y"))] if root.endswith("k") else []
        for source, f in forms:
            t, c = count.get(f, (0, 0))
            if f in taken or f == "loserin" or c >= max(1, t):
                continue
            taken.add(f)
            got[f] = (r["Id"], source)
    rows = variations.where("Source in ('mined', 'inflect', 'rule')").collect()
    assert {r["NormalizedVariation"]: (r["BadWordId"], r["Source"]) for r in rows} == got


def test_leet_order_and_cap(spark):
    from itertools import combinations

    df = spark.createDataFrame([(1, "baseiogt"), (2, "xyz"), (3, "a")], "Id int, root_key string")
    got = [r["spelling"] for r in lexicon.leet_forms(df).where("Id = 1").orderBy("place").collect()]
    want = []
    for size in range(1, 9):
        for chosen in combinations([c for c in C.LEET if c in "baseiogt"], size):
            want.append("baseiogt".translate({ord(c): C.LEET[c] for c in chosen}))
    assert got == want[: C.LEET_CAP] and lexicon.leet_forms(df).where("Id <> 1").count() == 0


def test_store(spark, built, tmp_path):
    words, variations, white, *_ = built
    n = sinks.save_store(words, variations, white, str(tmp_path / "store"))
    assert n["BadWords"] == 2 and n["Whitelist"] == 1
    w = spark.read.parquet(str(tmp_path / "store/BadWords"))
    hidden = w.withColumn("IsActive", F.col("Id") != 1)
    assert {r["BadWordId"] for r in lexicon.lookup(hidden, variations).collect()} == {3}
    stay, left = lexicon.delete_words(words, variations, F.col("Id") == 1)
    assert {r["BadWordId"] for r in left.collect()} == {3} and lexicon.orphans(stay, variations).count() > 0
    broken = variations.limit(1).withColumn("Source", F.lit("guess")).withColumn("BadWordId", F.lit(99))
    assert {r["rule"] for r in lexicon.violations(words.withColumn("Severity", F.lit(9)), broken, white).collect()} >= {"severity", "source", "orphan"}
    sinks.write_script(sinks.seed_script(words, variations, white), str(tmp_path / "seed"))
    lines = next((tmp_path / "seed").glob("part-*")).read_text().splitlines()
    assert lines[0] == "DELETE FROM WordVariations;" and sum(x.endswith(";") for x in lines) == 6
    plan = lexicon.lookup(words, variations)
    lexicon.fresh(spark, words, variations, white)
    assert spark.sql("SELECT MatchType FROM LexiconLookup WHERE NormalizedForm = 'loser'").first()[0] == "base" and plan.groupBy("NormalizedForm").count().where("count > 1").count() == 0


def test_built_files_load_again(spark, built, tmp_path):
    words, variations, white, *_ = built
    for name, df in (("bad_words", words), ("word_variations", variations), ("whitelist", white)):
        sinks.write_csv(df, str(tmp_path / f"{name}.csv"), df.columns)
    lookup, again = tables.load_lexicon(spark, str(tmp_path))
    assert sorted(map(tuple, lookup.collect())) == sorted(map(tuple, lexicon.lookup(words, variations).collect())) and again.count() == 1
    df = spark.createDataFrame([("1", "loserhed", None, None)], tables.REQUEST)
    assert moderate.answer(df, lookup, again)[0].first()["outcome"] == "held_for_review"
    with pytest.raises(RuntimeError):
        moderate.answer(df, None, None)


def test_lookup_is_broadcast(spark, lex, white):
    df = spark.createDataFrame([(1, "kitab")], "id int, text string")
    plan = match.scan(df, ["id"], lex, white)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_mining(spark):
    rows = [(i, "bad word", 1, i % 2) for i in range(12)] + [(100 + i, "good word bad" if i == 0 else "good word", 0, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int, quality int")
    got = mining.candidates(df, ("quality",)).collect()
    assert [(r["Candidate"], r["ToxicCount"], r["CleanCount"], r["SuggestedCategory"], r["CategoryCount"]) for r in got] == [("bad", 12, 1, "quality", 6)]
    assert mining.candidates(df.where("false"), ("quality",)).count() == 0


def test_votes(spark):
    rows = [(1, "Same text!", 1, 0), (2, "same  text", 0, 0), (3, "other", 1, 1), (4, "!!", 1, 0), (5, "!!", 0, 0), (6, "x y", 0, 1), (7, "X y", 0, 1), (8, "x, y", 1, 0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int, quality int")
    got = {r["doc_id"]: (r["toxic"], r["quality"], r["changed"]) for r in labels.vote(df, ["toxic", "quality"]).collect()}
    assert got == {1: (1, 0, False), 2: (1, 0, True), 3: (1, 1, False), 4: (1, 0, False), 5: (0, 0, False), 6: (0, 1, False), 7: (0, 1, False), 8: (0, 1, True)}
    groups = labels.vote_groups(df, ["toxic", "quality"])
    assert sorted(r[0] for r in groups.select(labels.ties(groups, ["toxic", "quality"])).collect()) == [0, 1]


def test_split(spark):
    rows = [(i, f"text {i % 150}", int(i % 150 < 30)) for i in range(300)] + [(1000, "tie!", 1), (1001, "tie", 0)]
    got = labels.split(spark.createDataFrame(rows, "doc_id int, text string, toxic int")).collect()
    assert len(got) == 302 and len({(r["near_key"], r["split"]) for r in got}) == 151
    groups = {r["near_key"]: (r["toxic"], r["split"]) for r in got if r["near_key"] != "tie"}
    assert sum(1 for t, s in groups.values() if t and s == "train") == 24 and sum(1 for t, s in groups.values() if t and s == "val") == 3


def test_sweep_and_best(spark):
    rows = [("a", s / 100, int(s >= 60)) for s in range(0, 100, 3)] + [("b", 0.1, 0)]
    df = spark.createDataFrame(rows, "label string, score double, truth int")
    swept = evaluation.sweep(df, "label")
    at = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in swept.where("label = 'a'").collect()}
    for t in (20, 29, 57, 58, 60, 95):
        assert at[t] == tuple(sum(1 for _, s, y in rows[:-1] if c(s >= t / 100, y)) for c in (lambda p, y: p and y, lambda p, y: p and not y, lambda p, y: not p and y))
    assert {r["label"]: r["threshold"] for r in evaluation.best(swept, "label").collect()} == {"a": 0.58, "b": 0.5}
    few = evaluation.decide_thresholds(df.withColumn("id", F.monotonically_increasing_id()), "label", "id")
    assert all(r["threshold"] == 0.5 and r["reason"].startswith("only") for r in few.collect())


def test_confusion_undefined(spark):
    r = evaluation.confusion(spark.createDataFrame([(False, False)], "p boolean, t boolean"), F.col("p"), F.col("t")).first()
    assert (r["precision"], r["recall"], r["f1"], r["clean_total"]) == (0.0, 0.0, 0.0, 1)


def test_obfuscation_and_noise(spark):
    df = spark.createDataFrame([(i, "salam dostlar bu kitab yaxşı") for i in range(300)], "id int, text string")
    out = [r[0] for r in df.select(evaluation.obfuscate(F.col("text"), F.col("id"))).collect()]
    assert all(len(x.split(" ")) == 5 and "ş" not in x for x in out) and 200 < sum(any(c.isdigit() for c in x) for x in out) <= 300
    noisy = [r["text"] for r in evaluation.augment(df, F.col("id")).collect()]
    assert {len(x.split(" ")) for x in noisy} == {4, 5} and len(set(noisy)) > 100
    short = spark.createDataFrame([(1, "abc"), (2, ""), (3, "a b")], "id int, text string")
    assert evaluation.augment(short, F.col("id")).count() == 3


def test_rare_rows(spark):
    df = spark.createDataFrame([(i, "bir iki üç dörd", int(i < 3)) for i in range(10)], "doc_id int, text string, toxic int")
    got = evaluation.rare_rows(df, "doc_id", "toxic", 20)
    assert got.count() == 17 and {r["doc_id"] for r in got.collect()} == {0, 1, 2}
    assert evaluation.rare_rows(df, "doc_id", "toxic", 3).count() == 0
    assert evaluation.rare_rows(df.where("false"), "doc_id", "toxic", 3).count() == 0


def test_char_grams(spark):
    def slow(text):
        out = []
        for w in text.lower().split():
            w = f" {w} "
            for n in range(2, 7):
                out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
                if n >= len(w):
                    break
        return sorted(out)

    for t in ("a", "ab cde", "Salam Dünya kitablar", ""):
        assert sorted(spark.range(1).select(features.char_grams(F.lit(t))).first()[0]) == slow(t)


def test_tfidf_rows_have_length_one(spark):
    df = spark.createDataFrame([(1, "ab ab cd"), (2, "ab"), (3, "cd ef")], "id int, text string")
    w = features.tfidf(df, ["id"], features.word_grams(F.col("text")))
    assert all(abs(r[1] - 1) < 1e-12 for r in w.groupBy("id").agg(F.sum(F.col("weight") ** 2)).collect())
    v, terms = features.vectors(w, ["id"])
    assert v.first()["features"].size == terms.count()


def test_models(spark, tmp_path):
    rows = [(i, ("pis söz " if i % 3 == 0 else "yaxşı söz ") + f"w{i % 7}", int(i % 3 == 0)) for i in range(60)]
    df = features.hashed(spark.createDataFrame(rows, "doc_id int, text string, toxic int"), features.word_grams(F.col("text")), 256).cache()
    scored = features.scores(features.logistic(df, "toxic", iterations=20), df)
    assert evaluation.confusion(scored, F.col("score") >= 0.5, F.col("toxic") == 1).first()["f1"] == 1.0
    svm, a, b = features.support_vectors(df, "toxic", 10)
    assert a > 0
    ranked = features.experiments({"words": lambda d: d}, df, df, ["toxic"])
    assert ranked[0][0] == "words" and ranked[0][1] == 1.0
    assert tables.load_model(str(tmp_path / "none")) is None


def test_thresholds_file(spark, tmp_path):
    assert tables.load_thresholds(None) == dict.fromkeys(C.LABELS, 0.5)
    rows = spark.createDataFrame([("insult", 0.42, "fitted on validation")], "label string, threshold double, reason string")
    sinks.write_thresholds(rows, str(tmp_path / "t.json"))
    assert tables.load_thresholds(str(tmp_path / "t.json"))["insult"] == 0.42


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c\nd', *["1.0"] * 7), ("x", *["0.0"] * 7)], tables.COMMENTS)
    sinks.write_csv(df.withColumn("more", F.lit(1)), str(tmp_path / "c"), tables.COMMENTS.names)
    got = tables.read_comments(spark, str(tmp_path / "c")).collect()
    assert sorted((r["comment"], r["toxicity"]) for r in got) == [('a "b", c\nd', 1), ("x", 0)]
    assert tables.sample_rows(df, "comment", 1).count() == 1


def test_retrieval(spark):
    q = spark.createDataFrame([(1, "Gradient descent direction"), (2, "zzz"), (3, None)], "id int, text string")
    c = spark.createDataFrame([(1, "a list is mutable"), (2, "gradient descent moves"), (3, "descent gradient")], "item_id int, text string")
    got = {(r["id"], r["rank"]): (r["item_id"], r["score"]) for r in retrieval.top_chunks(q, ["id"], c, "item_id", 2).collect()}
    assert got == {(1, 1): (2, 2), (1, 2): (3, 2), (2, 1): (1, 0), (3, 1): (1, 0)}


def test_review_and_relabel(spark, lex, white):
    rows = [(1, "kitab", 0, 0, "train"), (2, "qələm", 0, 0, "train"), (3, "kitab", 0, 0, "val"), (4, "kitab", 1, 0, "train"), (5, "ok", 0, 0, "train")]
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int, insult int, split string")
    checked = match.check(df, ["doc_id"], lex, white)
    queue = {r["doc_id"]: (r["Applied"], r["WhyNotApplied"]) for r in labels.review_queue(checked).collect()}
    assert queue == {1: (True, ""), 2: (False, "severity 1 below auto-apply threshold"), 3: (False, "val/test held out")}
    fixed = {r["doc_id"]: (r["toxic"], r["insult"]) for r in labels.relabel(checked).collect()}
    assert fixed == {1: (1, 1), 2: (0, 0), 4: (1, 0), 5: (0, 0)}


def test_health(spark, lex):
    r = gate.health(lex, False).first()
    assert (r["status"], r["lexicon_forms"], r["classifier_loaded"]) == ("ok", 3, False)


def test_word_grams_keep_nulls_and_short_texts(spark):
    texts = [(1, "Bir iki üç"), (2, "bir"), (3, ""), (4, None)]
    got = spark.createDataFrame(texts, "id int, text string").select("id", features.word_grams(F.col("text")).alias("g")).collect()
    assert {r["id"]: r["g"] for r in got} == {1: ["bir", "iki", "üç", "bir iki", "iki üç"], 2: ["bir"], 3: [], 4: None}


def test_union_against_the_long_form(spark):
    texts = [(1, "ab ab cd"), (2, "ab cd ef"), (3, "cd ef"), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    block = features.words()
    fitted = features.fit_block(df, block)
    long = features.tfidf(df, ["id"], features.word_grams(F.col("text")), cap=block.cap)
    want = {}
    for r in long.collect():
        want.setdefault(r["id"], {})[r["term"]] = r["weight"]
    vocabulary = fitted[1].vocabulary
    for r in features.union(fitted)(df).collect():
        got = {vocabulary[i]: w for i, w in zip(r["features"].indices, r["features"].values)}
        assert got == pytest.approx(want.get(r["id"], {}))
    both = features.union(features.fit_block(df, features.characters(2, 3, 5)), fitted)(df).first()["features"]
    assert both.size == 5 + len(vocabulary)
    none = features.fit_block(df.where("false"), block)
    assert none is None and features.fit_block(df.where("id > 3"), block) is None
    assert features.union(none)(df).first()["features"].size == 1


def test_one_vs_rest_scores_every_label(spark):
    rows = [(i, ("pis söz " if i % 3 == 0 else "yaxşı söz ") + f"w{i % 2}", int(i % 3 == 0), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int, odd int")
    fit = features.union(features.fit_block(df, features.characters(2, 3, 500)), features.fit_block(df, features.words()))(df).cache()
    for classifier in (features.by_logistic(), features.by_support_vectors(iterations=10)):
        scored = features.one_vs_rest(fit, fit, ["toxic", "odd"], classifier, "doc_id")
        per = evaluation.confusion(scored, F.col("score") >= 0.5, F.col("truth") == 1, "label").collect()
        assert {r["label"]: r["f1"] for r in per} == {"toxic": 1.0, "odd": 1.0}


def test_fits_tell_the_driver_of_few_partitions(spark):
    rows = spark.range(0, 40_000, 1, 40).withColumn("toxic", (F.col("id") % 3 == 0).cast("int"))
    fit, n = features.balanced(rows, "toxic")
    assert n == 40_000 and fit.count() == n
    assert fit.rdd.getNumPartitions() <= features.PARTITIONS_A_CORE * spark.sparkContext.defaultParallelism


def test_tfidf_shuffles_no_row_of_terms(spark):
    df = spark.createDataFrame([(i, f"ab cd w{i % 5} w{i % 7}") for i in range(50)], "id int, text string")
    w = features.tfidf(df, ["id"], features.word_grams(F.col("text")))
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(id#" in plan
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(id#" in x and ", term#" in x]


def test_whitelisted_is_one_pass(spark, white):
    df = spark.createDataFrame([("kitabxanada",), ("sasa",), ("kitabxana",), ("sasam",), ("",), ("kitab",)] * 2, "key string")
    out = match.whitelisted(df, white)
    assert sorted(r[0] for r in out.collect()) == ["kitabxana", "kitabxanada", "sasa"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    limit, match.CONSTANT_PREFIXES = match.CONSTANT_PREFIXES, 1
    try:
        assert sorted(r[0] for r in match.whitelisted(df, white).collect()) == ["kitabxana", "kitabxanada", "sasa"]
    finally:
        match.CONSTANT_PREFIXES = limit


def test_known_entries_leave_out_no_match(spark, lex, white):
    texts = [(1, "kitab kitablar kitablardan k i t a b sasdan kitabdirdan"), (2, "x y z"), (3, None), (4, "KİTABLARİN kitabxanada sakit sasa qələmsiz")]
    df = spark.createDataFrame(texts, "id int, text string")
    with_known = match.scan(df, ["id"], lex, white, n_entries=3)
    assert sorted(map(repr, with_known.collect())) == sorted(map(repr, match.scan(df, ["id"], lex, white).collect()))
    few = match.candidate_rows(df, ["id"], ["kitab", "sas", "qelem"])
    assert few.count() < match.candidate_rows(df, ["id"]).count()


def test_check_scans_its_source(spark, lex, white):
    df = spark.createDataFrame([(1, "kitab", 5), (2, "x", 6)], "id int, text string, more int")
    joined = df.join(spark.createDataFrame([(5, "a"), (6, "b")], "more int, split string"), "more")
    out = match.check(joined, ["id"], lex, white, 3, df.select("id", "text"))
    assert sorted(map(repr, out.collect())) == sorted(map(repr, match.check(joined, ["id"], lex, white, 3).collect()))
    short = out.select("id", "is_flagged")._jdf.queryExecution().optimizedPlan().toString()
    assert short.count("more#") < match.check(joined, ["id"], lex, white, 3).select("id", "is_flagged")._jdf.queryExecution().optimizedPlan().toString().count("more#")


def test_obfuscation_makes_two_digests_a_word(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, text string")
    assert df.select(evaluation.obfuscate(F.col("text"), F.col("id"))).columns[0].count("md5(") == 2


def test_scores_from_sums_at_hand(spark):
    df = spark.createDataFrame([(1, "ab cd ab"), (2, "cd"), (3, "x")], "id int, text string")
    weights = spark.createDataFrame([("ab", 2.0), ("cd", -1.0)], "key string, weight double")
    sums = evaluation.key_sums(df, ["id"], weights)
    own, given = evaluation.linear_scores(df, ["id"], weights, -1.0), evaluation.linear_scores(df, ["id"], None, -1.0, sums)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, given.collect()))
    each = evaluation.label_scores(df, ["id"], None, {"l": -1.0}, sums)
    assert {r["id"]: r["score"] for r in each.collect()} == {r["id"]: r["toxicity_score"] for r in given.collect()}
