"""Secret scans with a random forest against false positives, native.

Candidates are of two kinds. Long ones are runs of at least 16 characters of
keys (segments may be joined by dots, and padding of '=' counts) that hold a
digit or a capital after a small letter. Short ones are values of at least 8
characters that are assigned to a name of secrets (password, token and so on,
in four languages), of any characters but spaces, quotes and separators. Each
candidate is described by its length, the transitions between its characters,
how much of it dictionary words cover, the path of its document, and the words
beside it. A random forest, trained on labelled findings, gives the chance that
it is a secret. The trained trees are compiled to conditional expressions, so a
document is scanned where it lies: no shuffle, no Python.

Labelled findings have columns before, candidate, after, path and label (1: a
secret); at most MOST_LABELLED of them, chosen by a hash, are used. Where none
are given, a fixed set is made by rule: keys of several services and formats
beside words that name secrets, against digests, identifiers, numbers, paths and
placeholders. There, a named key in tests or documents is an example and no
secret, and a bare key in a file of settings is one, so that paths tell. A
forest is trained once, stored in the shared folder under its version (a digest
of what it was trained on) and loaded from there.

Defined cases: a null or empty text has no findings; candidates of any length
are judged; a chance equal to the threshold is a secret; repeated rows give
their findings again; a null path is an empty one; labelled findings of one
class only are an error; an empty table gives an empty table; extra columns are
ignored, or carried by redact.
"""

from __future__ import annotations

import hashlib
import inspect
import sys
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, hadoop_path, need, shared_dir, whole

THRESHOLD, TREES, DEPTH, MOST_LABELLED, MADE, SEED = 0.5, 24, 7, 20_000, 12_000, 11
BEFORE, AFTER = 64, 32

#: Names that a value of any form is assigned to, and words that name a secret in general.
ASSIGNED = (
    "passw(?:or)?d|passwort|kennwort|passwd|pwd|passphrase|contrase(?:ñ|n)a|clave|mot_?de_?passe|mdp|secret|token|"
    "api_?key|apikey|access_?key|private_?key|credential|auth_?key"
)
SECRET_WORDS = "token|secret|passw|pwd|passphrase|api.?key|auth|bearer|credential|private.?key|access.?key|signing.?key|kennwort|contrase|clave|mot.?de.?passe|mdp|jeton|geheim"
#: Words that name something else.
OTHER_WORDS = (
    "commit|sha.?[0-9]*|md5|hash|digest|checksum|uuid|guid|revision|etag|integrity|build|version|isbn|order|invoice|"
    "phone|card|account|number|blob|tree|id|line|page|nummer|rechnung|numero|factura|commande|konto|author|auteur|autor"
)

_R = "[A-Za-z0-9+/_-]"
_U = rf"(?:{_R}|\.(?={_R}))"
_END = "(?![A-Za-z0-9+/=_-])"
#: A run begins where no run does, holds what is asked of it, and ends with its padding.
LONG = (
    rf"(?<!{_R})(?<!{_R}\.)(?=[A-Za-z+/_.-]*[0-9]|[A-Za-z+/_.-]*?[a-z][A-Z])"
    rf"(?={_R}{_U}{{15}}|{_R}{_U}{{14}}={{1,2}}{_END}|{_R}{_U}{{13}}=={_END}){_R}++(?:\.{_R}++){{0,20}}+(?:={{1,2}}{_END})?+"
)
SHORT = (
    rf"(?<=[=:\"'`]|[=:] )(?<=(?i:{ASSIGNED})[A-Za-z_]{{0,12}}[\"'`]?[ ]{{0,2}}[=:][ ]{{0,2}}[\"'`]?)"
    r"(?:(?<=[\"'`])[^\s\"'`]{8,}+(?=[\"'`])|[^\s\"'`<>,;&]{7,}[^\s\"'`<>,;&.])"
)
CANDIDATE = f"{SHORT}|{LONG}"

#: Words whose presence in a candidate speaks for an identifier, not a key: of programs, then German, French, Spanish.
DICTIONARY = (
    "access", "account", "address", "application", "array", "batch", "build", "button", "cache", "change", "class",
    "client", "code", "column", "config", "content", "count", "create", "data", "date", "default", "delete", "device",
    "document", "element", "email", "error", "event", "example", "factory", "file", "filter", "first", "format", "function",
    "group", "handler", "header", "host", "image", "index", "input", "item", "label", "last", "length", "list", "local",
    "mail", "manager", "message", "method", "model", "module", "name", "number", "object", "option", "order", "output",
    "package", "page", "param", "password", "path", "process", "profile", "project", "python", "query", "read", "report",
    "request", "response", "result", "schema", "script", "secret", "server", "service", "session", "source", "start",
    "state", "status", "string", "system", "table", "test", "text", "time", "title", "token", "type", "update", "user",
    "value", "version", "view", "window", "write",
    "anwendung", "auftrag", "bearbeiten", "beispiel", "benutzer", "bericht", "datei", "datum", "ergebnis", "fehler",
    "kennwort", "konto", "kunde", "nachricht", "nummer", "ordner", "passwort", "rechnung", "seite", "sprache", "straße",
    "verzeichnis", "vorlage", "wert", "zeichen",
    "adresse", "annuler", "bonjour", "commande", "compte", "dossier", "erreur", "exemple", "facture", "fichier", "langue",
    "liste", "modifier", "mot", "nombre", "nouveau", "numero", "passe", "projet", "rapport", "resultat", "serveur",
    "utilisateur", "valeur",
    "archivo", "buscar", "cambiar", "carpeta", "clave", "codigo", "correo", "cuenta", "ejemplo", "fecha", "idioma",
    "mensaje", "nombre", "nuevo", "pagina", "pedido", "prueba", "servidor", "usuario", "valor",
)
#: Beginnings of keys that services give out.
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live|sk-|eyJ[A-Za-z0-9_-]+\.|AIza|glpat-|npm_)"
#: Frequent pairs of letters.
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea"
PLACEHOLDERS = r"example|placeholder|changeme|dummy|sample|xxxx|your|0000000|1234567|redacted|\*\*\*\*|^[$%{<\[]|\(|environ|getenv"
EXAMPLES = "(^|[/._-])(test|tests|example|examples|sample|samples|doc|docs|vendor|fixture|fixtures|lock|readme)([/._-]|$)"
SETTINGS = r"(^|[/._-])(env|conf|config|settings|secrets|credentials|deploy|prod)([/._-]|$)|\.(env|ini|cfg|tfvars|properties)$"

Tree = float | tuple
"""The chance at a leaf, or (feature, threshold, tree where it is at most that, tree where it is more)."""


def features(candidate: Column, before: Column, after: Column, path: Column) -> list[Column]:
    c, b, a, p = candidate, F.lower(before), after, F.lower(whole(path))
    n = F.length(c).cast("double")
    low = F.lower(c)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return [
        n,
        F.regexp_count(c, F.lit("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")) / n,
        F.regexp_count(c, F.lit("[0-9]")) / n,
        flag(c.rlike("^[0-9a-fA-F]+$")),
        F.size(F.array_distinct(F.split(c, ""))) / n,
        F.regexp_count(low, F.lit(f"(?={PAIRS})")) / n,
        (n - F.length(F.regexp_replace(low, "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))), ""))) / n,
        F.regexp_count(c, F.lit("[/_.-]")) / n,
        flag(b.rlike(r"([/\\@]|https?:\S*)$")),
        flag(p.rlike(EXAMPLES)),
        flag(b.rlike(f"({SECRET_WORDS})[a-z_]{{0,12}}[^a-z0-9]{{0,8}}$")),
        flag(b.rlike(f"(^|[^a-z])({OTHER_WORDS})[^a-z0-9]{{0,8}}$")),
        flag(b.rlike("[=:][ \"'`]*$")),
        flag(b.rlike("[\"'`]$") & a.rlike("^[\"'`]")),
        flag(low.rlike(PLACEHOLDERS)),
        flag(c.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")),
        flag(c.rlike(KNOWN)),
        flag(p.rlike(SETTINGS)),
        F.regexp_count(c, F.lit("[^A-Za-z0-9+/_.=-]")) / n,
    ]


def made_findings(spark: SparkSession, n: int = MADE) -> DataFrame:
    """A fixed set of labelled findings, made by rule from digests of their numbers."""
    pick = lambda salt, options: F.element_at(
        F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int")
    )
    s = F.col("id").cast("string")
    word = lambda salt: pick(salt, DICTIONARY)
    # parts are columns of their own: written out in every kind they would outgrow a compiled method
    rows = spark.range(0, n, 1, 1).select(
        "id", F.sha1(s).alias("hex40"), F.md5(s).alias("hex32"), F.sha2(s, 256).alias("hex64"),
        F.base64(F.unhex(F.sha2(F.concat(s, F.lit("b")), 256))).alias("b64"),
        F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(s, F.lit("a")), 512))), "[^A-Za-z0-9]", "").alias("letters"),
        F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(s, F.lit("e")), 512))), "[^A-Za-z]", "").alias("mixed"),
        F.regexp_replace(F.sha2(F.concat(s, F.lit("d")), 512), "[^0-9]", "").alias("digits"),
        pick("p", ["the value was found here ", "und die der ", "que la de ", "of and the then ", "x "]).alias("prose"),
        pick("w", ["token", "secret", "api_key", "password", "auth_token", "client_secret", "access_key", "apikey", "TOKEN", "private_key"]).alias("named"),
        pick("v", ["password", "passwort", "kennwort", "contraseña", "clave", "mot_de_passe", "PASSWORD", "db_password", "pwd", "secret", "token"]).alias("pass"),
        pick("o", ["commit", "sha256", "md5", "checksum", "revision", "etag", "build", "digest", "blob", "hash"]).alias("other"),
        pick("s", [' = "', "='", ": ", " = ", '="', ': "']).alias("sign"),
        pick("e", ["", ".", ",", "!!", "###", '"']).alias("dot"),
        pick("f", ["src/app.py", "web", "src0", "", "index.html", "src/main/app.js", "web", "src7"]).alias("plain"),
        pick("g", ["tests/test_auth.py", "docs/readme.md", "examples/sample.yml", "vendor/lib.js", "fixtures/keys.json", "package-lock.json"]).alias("shown"),
        pick("h", ["config/settings.yml", ".env", "deploy/secrets.yaml", "conf/credentials.ini", "prod.env", "terraform.tfvars"]).alias("settings"),
        pick("n", ["token", "API_KEY", "AWS_SECRET_ACCESS_KEY", "GITHUB_TOKEN", "export DB_PASSWORD", "client_secret", "SECRET_KEY", "auth_token"]).alias("setting"),
        pick("l", ["https://host.example.com/?", "https://api.host.org/items?page=2&", "http://host.net/a/b?", "GET /list?"]).alias("url"),
        pick("q", ["token", "access_token", "api_key", "apikey", "client_secret", "auth", "password"]).alias("parameter"),
        pick("r", ["", "&page=2", "&x=1", " "]).alias("rest"), pick("m", ["!", "#", "$", "@", "?", "%", "*", "+"]).alias("mark"),
        word("1").alias("word1"), word("2").alias("word2"), word("3").alias("word3"),
    )
    c = F.col
    upper = F.upper(F.substring(c("letters"), 1, 16))
    cut = lambda name, k, at=1: F.substring(c(name), at, k)
    forms = [F.concat(F.lit(a), b) for a, b in (
        ("ghp_", cut("letters", 36)), ("AKIA", upper), ("gho_", cut("letters", 36)), ("ASIA", upper), ("sk_live_", cut("letters", 24)),
        ("xoxb-", F.concat_ws("-", cut("digits", 11), cut("letters", 24))), ("AIza", cut("letters", 35)), ("glpat-", cut("letters", 20)),
        ("npm_", cut("letters", 36)), ("sk-", cut("letters", 48)),
        ("eyJ", F.concat(cut("letters", 17), F.lit(".eyJ"), cut("mixed", 40), cut("digits", 6), F.lit("."), cut("letters", 43))),
    )]
    passwords = [
        F.concat("word1", cut("digits", 4), "mark"), F.concat(cut("mixed", 5), "mark", cut("digits", 3), cut("mixed", 3, 9)), cut("letters", 10), cut("mixed", 20),
        F.concat(cut("mixed", 3), cut("digits", 3), cut("mixed", 4, 5)), F.concat(F.initcap(c("word1")), "mark", cut("digits", 3), cut("mixed", 2)), F.concat(cut("letters", 12), "mark"),
    ]
    at = lambda salt, options: F.element_at(F.array(*options), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    rows = rows.withColumns({
        "uuid": F.concat_ws("-", *[cut("hex32", k, a) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        "quote": F.when(F.substring("sign", -1, 1).isin('"', "'"), F.concat(F.substring("sign", -1, 1), "dot")).otherwise(c("dot")),
        "service": at("k", forms), "phrase": at("z", passwords), "before": F.concat("prose", "named", "sign"), "asked": F.concat("prose", "pass", "sign"),
        "kept": F.concat("prose", "setting", F.lit("=")), "query": F.concat("prose", "url", "parameter", F.lit("=")),
    })
    text = lambda *parts: F.concat(*[F.lit(x[1:]) if x.startswith("|") else c(x) for x in parts])
    nothing = F.lit("")
    placeholder = F.concat(pick("h", ["xxxxxxxxxxxxxxxx", "YOUR_API_KEY_EXAMPLE_", "changeme_changeme_", "example_token_value_"]), cut("digits", 3))
    #: How a kind is labelled: a named key but in examples, a service's key always, a bare key in settings, none ever.
    named, service, bare, never = range(4)
    kinds = [  # (before, candidate, after, how it is labelled)
        (c("before"), c("hex40"), c("quote"), named), (c("before"), F.upper(c("hex40")), c("quote"), named), (c("before"), c("hex32"), c("quote"), named),
        (c("before"), c("hex64"), c("quote"), named), (c("before"), cut("b64", 28), c("quote"), named), (c("before"), cut("letters", 32), c("quote"), named),
        (c("before"), cut("mixed", 24), c("quote"), named), (c("asked"), c("phrase"), c("quote"), named), (c("asked"), c("phrase"), c("quote"), named), (c("asked"), c("phrase"), c("quote"), named),
        (c("kept"), c("phrase"), nothing, named), (c("kept"), c("hex40"), nothing, named), (c("kept"), cut("b64", 40), c("dot"), named), (c("query"), c("hex40"), c("rest"), named),
        (c("query"), cut("letters", 32), c("rest"), named), (text("prose", "|Authorization: Bearer "), cut("letters", 40), nothing, named),
        (c("before"), c("service"), c("quote"), service), (c("kept"), c("service"), nothing, service), (c("prose"), c("service"), c("dot"), service),
        (pick("b", ["", "key ", "use ", "("]), c("service"), c("dot"), service), (text("prose", "|aws_access_key_id = "), F.concat(F.lit("AKIA"), upper), nothing, service),
        (text("prose", "|Authorization: Bearer "), c("service"), nothing, service),
        (c("prose"), c("hex40"), c("dot"), bare), (c("prose"), cut("letters", 32), c("dot"), bare), (c("prose"), c("hex64"), c("dot"), bare), (text("prose", "|value = "), cut("letters", 28), nothing, bare),
        (c("prose"), c("hex40"), nothing, bare), (text("word1", "| "), cut("letters", 36), nothing, bare), (text("word1", "| "), c("hex40"), c("dot"), bare),
        (text("prose", "other", "sign"), c("hex40"), c("quote"), never), (text("prose", "other", "| "), c("hex64"), c("dot"), never), (text("prose", "other", "| "), c("hex32"), c("dot"), never),
        (c("prose"), c("uuid"), c("dot"), never), (F.concat("prose", pick("u", ["id: ", "uuid = ", "guid ", "token_id = "])), c("uuid"), nothing, never),
        (c("prose"), cut("digits", 16), c("dot"), never), (F.concat("prose", pick("c", ["card ", "order ", "phone: ", "account "])), cut("digits", 18), c("dot"), never),
        (text("prose", "|https://host.example.com/"), F.concat_ws("/", "word1", "word2", cut("digits", 6)), nothing, never),
        (text("prose", "|https://static.example.org/"), c("hex40"), nothing, never), (text("prose", "|see /usr/share/"), cut("letters", 30), nothing, never), (text("prose", "|name@"), F.concat_ws(".", "word1", "word2", F.concat("word3", cut("digits", 1)), F.lit("com")), nothing, never),
        (c("prose"), F.concat_ws(".", F.concat("word1", cut("digits", 1)), "word2", F.lit("example.com")), c("dot"), never),
        (c("before"), F.concat_ws("_", "word1", "word2", "word3", cut("digits", 2)), c("quote"), never), (c("asked"), F.concat_ws("_", "word1", "word2", "word3"), c("quote"), never),
        (c("asked"), F.concat("word1", "word2"), c("quote"), never), (c("asked"), F.concat(F.lit("get_"), c("word1"), F.lit("("), c("word2"), F.lit(")")), nothing, never),
        (c("asked"), F.concat("word1", F.initcap(c("word2")), F.initcap(c("word3")), F.lit("("), c("word1"), F.lit(")")), nothing, never),
        (c("asked"), F.concat(F.lit("${"), F.upper(c("word1")), F.lit("_"), F.upper(c("word2")), F.lit("}")), c("quote"), never), (c("asked"), F.lit("************"), c("quote"), never),
        (c("asked"), F.concat_ws(".", F.lit("os.environ"), F.lit("get"), "word1"), nothing, never),
        (c("prose"), F.concat("word1", F.initcap(c("word2")), F.initcap(c("word3")), cut("digits", 1)), c("dot"), never), (c("prose"), F.concat("word1", F.initcap(c("word2")), F.initcap(c("word3")), F.lit("Value")), c("dot"), never),
        (c("before"), placeholder, c("quote"), never), (c("kept"), placeholder, nothing, never), (text("prose", "|data:image/png;base64,"), c("b64"), nothing, never),
        (text("prose", "other", "|="), c("hex40"), c("dot"), never), (F.concat("prose", "url", pick("v", ["v", "id", "hash", "etag", "page"]), F.lit("=")), c("hex32"), c("rest"), never),
        (F.concat(c("prose"), F.upper(c("other")), F.lit("=")), c("hex64"), nothing, never), (F.concat("prose", pick("i", ["id", "uuid", "REQUEST_ID", "order"]), F.lit("=")), c("uuid"), c("rest"), never),
        (text("prose", "|usr/lib/"), F.concat_ws("/", F.lit("python3"), "word1", "word2", "word3"), nothing, never),
    ]
    kind = F.pmod(c("id"), F.lit(len(kinds)))
    place = F.pmod(F.xxhash64("id", F.lit("place")), F.lit(4))  # half in plain paths, a quarter each in examples and settings
    label = F.when(c("how") == named, place != 2).when(c("how") == service, True).when(c("how") == bare, place == 3).otherwise(False)

    def part(first: int, last: int) -> DataFrame:
        """Rows of some kinds; all in one expression would outgrow a compiled method."""
        of = lambda j: reduce(lambda x, i: F.when(kind == i, kinds[i][j] if j < 3 else F.lit(kinds[i][j])).otherwise(x), range(first, last), F.lit(None))
        return rows.where(kind.between(first, last - 1)).withColumn("how", of(3).cast("int")).select(
            of(0).cast("string").alias("before"), of(1).cast("string").alias("candidate"), of(2).cast("string").alias("after"),
            F.when(place == 2, c("shown")).when(place == 3, c("settings")).otherwise(c("plain")).alias("path"), label.cast("int").alias("label"),
        )

    return reduce(DataFrame.union, [part(k, min(k + 9, len(kinds))) for k in range(0, len(kinds), 9)])


def feature_names() -> list[str]:
    return [f"f{i}" for i in range(len(features(*[F.lit("")] * 4)))]


def described(findings: DataFrame) -> DataFrame:
    """findings(before, candidate, after, path, ...) plus a column for each feature."""
    each = features(F.col("candidate"), whole(F.col("before")), whole(F.col("after")), F.col("path"))
    return findings.select("*", *[f.alias(n) for f, n in zip(each, feature_names())])


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """The trained model of a forest on labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = need(labelled, "before", "candidate", "after", "path", "label").where("candidate is not null and label is not null")
    rows = rows.orderBy(F.xxhash64("before", "candidate", "after", "path"), "candidate", "label").limit(MOST_LABELLED)
    rows = described(rows).select(F.col("label").cast("double").alias("label"), *feature_names()).coalesce(1)
    if rows.agg(F.countDistinct("label")).first()[0] != 2:
        raise ValueError("labelled findings need secrets and others")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="9").fit(
        VectorAssembler(inputCols=feature_names(), outputCol="features").transform(rows)
    )


def load_trees(spark: SparkSession, path: str) -> list[Tree]:
    """The trees of a stored model."""
    nodes: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():  # TREES * 2^(DEPTH + 1) nodes at most
        nodes.setdefault(r["treeID"], {})[r["id"]] = r

    def tree(own: dict, i: int) -> Tree:
        r = own[i]
        if r["leftChild"] < 0:
            return r["impurityStats"][1] / sum(r["impurityStats"])
        return r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0], tree(own, r["leftChild"]), tree(own, r["rightChild"])

    return [tree(own, 0) for _, own in sorted(nodes.items())]


def forest(spark: SparkSession, labelled: DataFrame | None = None) -> list[Tree]:
    """The trees of the forest for these labelled findings, or the made ones: loaded if stored, else trained and stored."""
    if labelled is None:
        content = inspect.getsource(sys.modules[__name__])
    else:
        own = need(labelled, "before", "candidate", "after", "path", "label")
        content = str(tuple(own.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*own.columns).cast("decimal(38,0)"))).first())) + inspect.getsource(features)
    path = f"{shared_dir(spark)}/secret-forests/{hashlib.md5(content.encode()).hexdigest()}"
    folder, files = hadoop_path(spark, path)
    if not files.exists(folder):
        # Written aside and moved, so that what is found is whole.
        aside = f"{path}-{uuid.uuid4().hex}"
        fit(made_findings(spark) if labelled is None else labelled).write().save(aside)
        if not files.rename(hadoop_path(spark, aside)[0], folder):
            path = aside
    return load_trees(spark, path)


def vote(trees: list[Tree], prefix: str = "") -> str:
    """SQL for the mean of the trees' chances over the features prefix.f0, prefix.f1, ..."""

    def of(tree: Tree) -> str:
        if not isinstance(tree, tuple):
            return f"{float(tree)!r}D"
        i, most, low, high = tree
        return f"IF({prefix}f{i} <= {float(most)!r}D, {of(low)}, {of(high)})"

    return f"({' + '.join(map(of, trees))}) / {len(trees)}"


#: Candidates whose places are added up together.
_RUN = 64


def _starts(steps: Column) -> Column:
    """Starts of candidates from steps(g, n), their sizes n and the gaps g before them: added up in runs, so that no
    array is copied for each candidate. steps must be a column of its own; an expression would be worked out for each run."""
    runs = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _RUN).cast("int"))
    numbers, lists = F.array().cast("array<int>"), F.array().cast("array<array<int>>")

    def one(array: Column, first: Column) -> Column:
        return F.aggregate(
            array, F.struct(first.alias("at"), numbers.alias("out")),
            lambda s, x: F.struct((s["at"] + x["g"] + x["n"]).alias("at"), F.array_append(s["out"], s["at"] + x["g"]).alias("out")),
        )

    def add(s: Column, k: Column) -> Column:
        part = one(F.slice(steps, k * _RUN + 1, F.lit(_RUN)), s["at"])
        last = F.aggregate(F.slice(steps, k * _RUN + 1, F.lit(_RUN)), s["at"], lambda a, x: a + x["g"] + x["n"])
        return F.struct(last.alias("at"), F.array_append(s["out"], part["out"]).alias("out"))

    all_runs = F.aggregate(runs, F.struct(F.lit(0).alias("at"), lists.alias("out")), add, lambda s: s["out"])
    return F.when(F.size(steps) > 0, F.flatten(all_runs)).otherwise(numbers)


def with_findings(docs: DataFrame, trees: list[Tree], threshold: float = THRESHOLD) -> DataFrame:
    """docs(text, path) plus segments (the text between candidates), candidates, and findings:
    an array of (start, length, score, is_secret), start counted in characters from 0."""
    text = F.col("text")
    # what stands before a candidate may reach into the one before it (a long name that holds a digit)
    before = lambda i: F.concat(whole(F.get("candidates", i - 1)), F.get("segments", i))
    found = F.when(text.rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    d = docs.withColumn("candidates", F.coalesce(found, F.array().cast("array<string>")))
    d = d.withColumn("segments", F.when(F.size("candidates") > 0, F.split("text", CANDIDATE, -1)).otherwise(F.array(whole(text))))
    told = F.transform(
        "candidates",
        lambda c, i: F.struct(*[
            f.alias(n)
            for n, f in zip(feature_names(), features(
                c, F.right(before(i), F.lit(BEFORE)), F.left(F.get("segments", i + 1), F.lit(AFTER)), F.col("path")
            ))
        ]),
    )
    steps = F.zip_with(F.slice("segments", F.lit(1), F.size("candidates")), "candidates", lambda g, c: F.struct(F.length(g).alias("g"), F.length(c).alias("n")))
    d = d.withColumns({"_told": told, "_steps": steps})
    d = d.withColumn("_starts", _starts(F.col("_steps")))
    d = d.withColumn("_scores", F.expr(f"transform(_told, t -> {vote(trees, 't.')})"))
    # What a lambda refers to once may be worked out again for each element, so the arrays go in side by side.
    rows = F.arrays_zip(F.col("_starts"), F.col("_steps"), F.col("_scores"))
    return d.withColumn(
        "findings",
        F.transform(
            rows,
            lambda x: F.struct(
                x["_starts"].alias("start"), x["_steps"]["n"].alias("length"), F.round(x["_scores"], 6).alias("score"), (x["_scores"] >= threshold).alias("is_secret")
            ),
        ),
    ).drop("_told", "_steps", "_starts", "_scores")


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: doc_id, ordinal (from 0), start, length, candidate_sha256, score, is_secret.

    The document's source is its path.
    """
    trees = forest(docs.sparkSession, labelled)
    rows = need(docs, "doc_id", "text", "source").select("doc_id", "text", F.col("source").alias("path"))
    found = with_findings(rows.where(F.col("text").rlike(CANDIDATE)), trees, threshold)
    each = F.zip_with("findings", "candidates", lambda x, c: F.struct(x.alias("f"), F.sha2(c, 256).alias("sha")))
    return found.select("doc_id", F.posexplode(each).alias("ordinal", "x")).select(
        "doc_id", "ordinal", "x.f.start", "x.f.length", F.col("x.sha").alias("candidate_sha256"), "x.f.score", "x.f.is_secret"
    )


def redact(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD, mask: str = "[SECRET]") -> DataFrame:
    """docs, all of them, with each secret in text replaced by the mask."""
    trees = forest(docs.sparkSession, labelled)
    safe, names = carried(docs, "text", "source")
    found = with_findings(safe.withColumn("path", F.col("source")), trees, threshold)
    shown = F.zip_with("candidates", "findings", lambda c, x: F.when(x["is_secret"], F.lit(mask)).otherwise(c))
    ends = F.concat(shown, F.array(F.lit("")))
    text = F.array_join(F.zip_with("segments", ends, lambda s, c: F.concat(s, c)), "")
    hit = F.exists("findings", lambda x: x["is_secret"])
    return found.withColumn("text", F.when(hit, text).otherwise(F.col("text"))).select(*names).toDF(*docs.columns)
