"""WARC derivatives: from responses, linked metadata and plain-text conversion records.

A response record holds the HTTP message: status line, headers and the page as
payload. From it two records are derived, each with an id of its own and
WARC-Refers-To the response's id: `metadata` (application/warc-fields) with the
page's title, language, outlinks and every header of the source, and
`conversion` (text/plain) with the page's text. All three carry the target URI,
the date and the digest of their own block; the response also that of its
payload, which the derived records hold as the digest of their source (a field
of its own, since WARC-Payload-Digest would speak of the record itself). Ids
are UUIDs of the content, so a rebuilt derivative keeps its links. Everything is
one map over the pages.

Text: comments, scripts, styles, titles, templates and no-script parts go, tags
that break lines become line ends, others vanish, entities are decoded (numeric
ones, and the names of HTML 4; others stay as written), white space is squeezed
and empty lines go. Attributes may stand in double or single quotes or bare.

Defined cases: a null html is an empty payload with an empty conversion; a null
url is an empty target URI; line ends in a url are percent-encoded and those in
an outlink or language dropped, so that no value can begin a header line; rows
that repeat page_id, url and html are one capture and share their record ids;
an unclosed silent element runs to the end of the page; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, whole

DATE = "2024-01-01T00:00:00Z"
#: Entities that are looked for first; the others by name or number.
ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&middot;", "·"),
)
#: Names of HTML 4, without those above.
NAMED = {n: chr(c) for n, c in sorted(name2codepoint.items()) if f"&{n};" not in dict(ENTITIES)}
#: What HTML reads numbers 128 to 159 as, where Windows has a character there.
OLD = {n: c for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))}
ENTITY = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
#: Elements whose content is not text, and tags that end a line.
SILENT = ("script", "style", "noscript", "title", "template")
BREAKS = (
    "p|br|div|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|article|section|header|footer|nav|aside|main|blockquote|pre|hr|form|"
    "title|body|html|dl|dt|dd|figure|figcaption"
)
LINE = "\r\n"
#: Attributes with their values, in quotes or bare; what is no part of a value.
VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
LANGUAGE = r"(?i)<html\s(?:[^>]*?\s)?lang" + VALUE
LINK = r"(?i)<a\s(?:[^>]*?\s)?href" + VALUE
BARE = r"""^["']|["']$|[\r\n\t]"""
#: White space that is not a single space already.
MANY_SPACES = "[ \t-\r]{2,}|[\t-\r]"


def base32_sha1(text: Column) -> Column:
    """sha1: and the digest in the base 32 that WARC files use."""
    digest = F.sha1(text)
    digits = F.concat(*[F.lpad(F.lower(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)])
    return F.concat(F.lit("sha1:"), F.translate(digits, "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _numbered(name: Column) -> Column:
    """The character of an entity name that begins with '#'."""
    at = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).cast("int")
    char = F.decode(F.unhex(F.lpad(F.hex(at), 8, "0")), "UTF-32")
    wrong = (at == 0) | at.between(0xD800, 0xDFFF) | (at > 0x10FFFF)
    return F.when(wrong, "\ufffd").when(at == 160, " ").when(at.between(128, 159), F.translate(char, "".join(map(chr, OLD)), "".join(OLD.values()))).otherwise(char)


def _decoded(part: Column) -> Column:
    """What follows an ampersand, with the ampersand's entity decoded."""
    name = F.regexp_extract(part, ENTITY, 1)
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    char = F.when(F.startswith(name, F.lit("#")), _numbered(name)).when(name != "", F.try_element_at(names, name))
    out = F.coalesce(F.concat(char, F.substring(part, F.length(name) + 2, F.length(part))), F.concat(F.lit("&"), part))
    for entity, char in reversed(ENTITIES):
        out = F.when(F.startswith(part, F.lit(entity[1:])), F.concat(F.lit(char), F.substring(part, len(entity), 2**31 - 1))).otherwise(out)
    return out


def text_of(html: Column) -> Column:
    silent = rf"(?is)<!--.*?(?:-->|$)|<({'|'.join(SILENT)})(?:\s[^>]*)?>.*?(?:</\1\s*>|$)"
    x = F.regexp_replace(html, silent, "")
    x = F.regexp_replace(x, MANY_SPACES, " ")
    x = F.regexp_replace(x, rf"(?i)</?({BREAKS})(\s[^>]*)?/?>", "\n")
    x = F.regexp_replace(x, "<[^>]*>", "")
    x = F.array_join(F.transform(F.split(x, "&"), lambda part, i: F.when(i == 0, part).otherwise(_decoded(part))), "")
    x = F.regexp_replace(x, " *\n[ \n]*", "\n")
    return F.regexp_replace(x, "^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages(page_id, url, html): page_id, record_id, target_uri, date, http_headers, payload."""
    uri = F.replace(F.replace(whole(F.col("url")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    p = need(pages, "page_id", "url", "html").select("page_id", uri.alias("target_uri"), whole(F.col("html")).alias("payload"))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.octet_length("payload").cast("string"), F.lit(LINE + LINE),
    )
    return p.select(
        "page_id", record_id(F.lit("response"), whole(F.col("page_id").cast("string")), F.col("target_uri"), F.col("payload")).alias("record_id"),
        "target_uri", F.lit(date).alias("date"), headers.alias("http_headers"), "payload",
    )


def _metadata(html: Column, http_headers: Column) -> Column:
    title = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1), MANY_SPACES, " ")
    plain = lambda value: F.regexp_replace(value, BARE, "")
    lang = plain(F.regexp_extract(html, LANGUAGE, 1))
    links = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), plain)
    outlinks = F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), x, F.lit(" L a/@href" + LINE))), "")
    lines = F.filter(F.split(http_headers, LINE), lambda x: x != "")
    sources = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("source-header: "), x, F.lit(LINE))), "")
    return F.concat(F.lit("title: "), title, F.lit(LINE + "language: "), lang, F.lit(LINE), sources, outlinks)


def derive(records: DataFrame) -> DataFrame:
    """Response records and what is derived from each: page_id, warc_type, record_id, refers_to,
    target_uri, date, content_type, block, content_length, block_digest, payload_digest (of the response's payload),
    source_digest (the same, in what is derived from it)."""
    none = F.lit(None).cast("string")
    r = records.withColumn("digest", base32_sha1(F.col("payload")))
    derived = lambda kind: record_id(F.lit(kind), F.col("record_id"))
    each = F.array(
        F.struct(F.lit("response").alias("warc_type"), F.col("record_id").alias("id"), none.alias("refers_to"),
                 F.lit("application/http; msgtype=response").alias("content_type"), F.concat("http_headers", "payload").alias("block")),
        F.struct(F.lit("metadata").alias("warc_type"), derived("metadata").alias("id"), F.col("record_id").alias("refers_to"),
                 F.lit("application/warc-fields").alias("content_type"), _metadata(F.col("payload"), F.col("http_headers")).alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), derived("conversion").alias("id"), F.col("record_id").alias("refers_to"),
                 F.lit("text/plain; charset=utf-8").alias("content_type"), text_of(F.col("payload")).alias("block")),
    )
    is_source = F.col("x.refers_to").isNull()
    out = r.select("page_id", "target_uri", "date", "digest", F.explode(each).alias("x")).select(
        "page_id", "x.warc_type", F.col("x.id").alias("record_id"), "x.refers_to", "target_uri", "date", "x.content_type", "x.block",
        F.when(is_source, F.col("digest")).alias("payload_digest"), F.when(~is_source, F.col("digest")).alias("source_digest"),
    )
    return out.withColumns({"content_length": F.octet_length("block").cast("long"), "block_digest": base32_sha1(F.col("block"))})


def written(records: DataFrame) -> DataFrame:
    """page_id, warc_type and `record`: the whole record as it stands in a WARC file. A file of records is
    written with write.option("lineSep", "").text() over the column."""
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(LINE))).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + LINE), field("WARC-Type", F.col("warc_type")), field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Refers-To", F.col("refers_to")), field("WARC-Target-URI", F.col("target_uri")), field("WARC-Date", F.col("date")),
        field("WARC-Payload-Digest", F.col("payload_digest")), field("X-Source-Payload-Digest", F.col("source_digest")), field("WARC-Block-Digest", F.col("block_digest")),
        field("Content-Type", F.col("content_type")), field("Content-Length", F.col("content_length").cast("string")), F.lit(LINE),
    )
    return records.select("page_id", "warc_type", F.concat(head, F.col("block"), F.lit(LINE + LINE)).alias("record"))


def warc_report(pages: DataFrame) -> DataFrame:
    """The records of every page; text blocks in full, the response's block by its digest."""
    r = derive(responses(pages))
    return r.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest",
        "payload_digest", "source_digest", F.when(F.col("warc_type") != "response", F.col("block")).alias("block"),
    )


def _sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    silent = "|".join([r"<!--.*?(?:-->|$)", *[rf"<{t}(?:\s[^>]*)?>.*?(?:</{t}\s*>|$)" for t in SILENT]])
    x = f"regexp_replace(payload, '(?is){silent}', '', 'g')"
    x = f"regexp_replace({x}, '[ \\t-\\r]+', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)</?({BREAKS})(\\s[^>]*)?/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    names = {**NAMED, **{n[1:-1]: c for n, c in ENTITIES if "#" not in n}}
    table = "MAP {" + ", ".join(f"{quoted(n)}: {quoted(c)}" for n, c in names.items()) + "}"
    name = f"regexp_extract(part, '{ENTITY}', 1)"
    code = f"(CASE WHEN lower(substr({name}, 2, 1)) = 'x' THEN ('0x' || substr({name}, 3))::BIGINT ELSE substr({name}, 2)::BIGINT END)"
    old = "".join(f" WHEN {code} = {n} THEN {quoted(c)}" for n, c in OLD.items())
    char = (
        f"CASE WHEN starts_with({name}, '#') THEN CASE WHEN {code} = 0 OR {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 THEN chr(65533) WHEN {code} = 160 THEN ' '{old} "
        f"ELSE chr({code}::INTEGER) END WHEN {name} <> '' THEN ({table})[{name}] END"
    )
    decoded = f"coalesce({char} || substr(part, length({name}) + 2), '&' || part)"
    x = f"array_to_string(list_transform(string_split({x}, '&'), lambda part, i: CASE WHEN i = 1 THEN part ELSE {decoded} END), '')"
    x = f"regexp_replace(regexp_replace({x}, ' *\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    uuid = lambda h: f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"
    b32 = lambda c: (
        f"'sha1:' || array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
        f"1 + ((('0x' || substr(sha1({c}), 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '')"
    )
    nl = "chr(13) || chr(10)"
    plain = lambda v: f"regexp_replace({v}, {quoted(BARE)}, '', 'g')"
    return f"""
WITH p AS (SELECT page_id, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS target_uri, coalesce(html, '') AS payload FROM pages),
h AS (SELECT *, 'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || strlen(payload) || {nl} || {nl} AS http,
  md5('response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || target_uri || chr(10) || payload) AS m, {b32('payload')} AS digest FROM p),
i AS (SELECT *, {uuid('m')} AS id FROM h),
d AS (
  SELECT page_id, 'response' AS warc_type, id AS record_id, NULL AS refers_to, target_uri, 'application/http; msgtype=response' AS content_type, http || payload AS block, digest FROM i
  UNION ALL SELECT page_id, 'metadata', {uuid("md5('metadata' || chr(10) || id)")}, id, target_uri, 'application/warc-fields',
    'title: ' || regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '[ \\t-\\r]+', ' ', 'g') || {nl}
    || 'language: ' || {plain(f"regexp_extract(payload, {quoted(LANGUAGE)}, 1)")} || {nl}
    || 'source-header: HTTP/1.1 200 OK' || {nl} || 'source-header: Content-Type: text/html; charset=utf-8' || {nl}
    || 'source-header: Content-Length: ' || strlen(payload) || {nl}
    || array_to_string(list_transform(regexp_extract_all(payload, {quoted(LINK)}, 1), lambda y: 'outlink: ' || {plain("y")} || ' L a/@href' || {nl}), ''), digest FROM i
  UNION ALL SELECT page_id, 'conversion', {uuid("md5('conversion' || chr(10) || id)")}, id, target_uri, 'text/plain; charset=utf-8', {x}, digest FROM i)
SELECT page_id, warc_type, record_id, refers_to, target_uri, '{DATE}' AS date, content_type, strlen(block)::BIGINT AS content_length,
  {b32('block')} AS block_digest, CASE WHEN warc_type = 'response' THEN digest END AS payload_digest, CASE WHEN warc_type <> 'response' THEN digest END AS source_digest,
  CASE WHEN warc_type <> 'response' THEN block END AS block FROM d
"""


WARC_SQL = _sql()
