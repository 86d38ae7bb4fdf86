"""Plan tables from the stored tables.

The stored tables have no page geometry, roles or confidences; these adapters derive
them deterministically (an invention of this library, documented here):

* a page's elements are the texts after its opening title, h1, p, b, br, a, div and
  footer tags; the document is the host without ``www.`` or ``m.``, page numbers follow
  page_id, boxes are equal bands of 0..1000;
* a document's elements are its lines, ten to a page;
* the smallest of four confidences, and an agreement, are residues of the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions.dialect import DUCK, SPARK
from pagelore.functions.ordinals import ordinal
from pagelore.sources.derived import DERIVED

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_SCRIPT = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
_COMMENT = r"(?s)<!--.*?-->"
_OPEN = r"<(?:title|h1|p|b|br|a|div|footer)(?:\s[^>]*)?>[^<]*"
_TAG, _TEXT = r"^<([a-z0-9]+)", r">([^<]*)$"
_HOST = r"^[a-z][a-z0-9+.-]*://([^/:?#]+)"
LINES_A_PAGE = 10


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DERIVED = """
  CASE tag WHEN 'title' THEN 'DocumentTitle' WHEN 'h1' THEN 'H1' WHEN 'a' THEN 'LI' ELSE 'P' END AS role, text,
  CAST(0 AS DOUBLE) AS l, 1000.0D * (ord - 1) / n AS t, CAST(1000 AS DOUBLE) AS r, 1000.0D * ord / n AS b,
  least((page_id * 31 + page_number * 17 + ord * 7) % 100, (page_id * 31 + page_number * 17 + ord * 11) % 100,
        (page_id * 31 + page_number * 17 + ord * 13) % 100, (page_id * 31 + page_number * 17 + ord * 19) % 100) / 100.0D AS conf,
  ((page_id * 7 + ord * 3) % 100) / 100.0D AS agree"""


def page_elements(pages: DataFrame) -> DataFrame:
    """doc_id, page_id, page_number, ord, n, role, text, l, t, r, b, conf, agree of every page element."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), _SCRIPT, ""), _COMMENT, "")
    host = F.regexp_replace(F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), _HOST, 1), r"^(?:www|m)\.", "")
    items = F.filter(
        F.transform(F.regexp_extract_all(bare, F.lit(_OPEN), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, _TAG, 1).alias("tag"), F.trim(F.regexp_extract(x, _TEXT, 1)).alias("text"))),
        lambda y: y["text"] != "",
    )
    numbered = ordinal(pages.select("page_id", host.alias("doc_id"), items.alias("items")), "doc_id", "page_id", "page_number")
    rows = numbered.select("doc_id", "page_id", "page_number", F.size("items").cast("long").alias("n"), F.posexplode("items").alias("i", "e")).select("doc_id", "page_id", "page_number", (F.col("i") + 1).cast("long").alias("ord"), "n", "e.tag", "e.text")
    return rows.selectExpr("doc_id", "page_id", "page_number", "ord", "n", *(x.strip() for x in _split_derived()))


def _split_derived() -> list[str]:
    parts, depth, cur = [], 0, ""
    for c in _DERIVED:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += c
    return [*parts, cur]


def _duck_elements() -> str:
    d = DUCK
    bare = d.replace(d.replace("coalesce(html, '')", _SCRIPT, ""), _COMMENT, "")
    host = d.replace(d.extract("lower(coalesce(url, ''))", _HOST, 1), r"^(?:www|m)\.", "")
    items = d.keep(d.extract_all(bare, _OPEN), "x", f"trim({d.extract('x', _TEXT, 1)}) <> ''")
    base = f"(SELECT page_id, {host} AS doc_id, {items} AS items FROM pages)"
    numbered = f"(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_id) AS page_number, CAST(len(items) AS BIGINT) AS n FROM {base})"
    rows = f"(SELECT doc_id, page_id, page_number, n, ord, {d.extract('x', _TAG, 1)} AS tag, trim({d.extract('x', _TEXT, 1)}) AS text FROM {d.explode(numbered, 'items', 'ord', 'x')})"
    return f"SELECT doc_id, page_id, page_number, ord, n, {_DERIVED.replace('0D', '0')} FROM {rows}".replace("1000.0 *", "CAST(1000 AS DOUBLE) *").replace("/ 100.0 ", "/ CAST(100 AS DOUBLE) ")


def document_lines(documents: DataFrame) -> DataFrame:
    """doc_id, page_number, ord, text of every line of every document."""
    rows = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "text"))
    return rows.select("doc_id", (F.expr(f"i div {LINES_A_PAGE}") + 1).cast("long").alias("page_number"), (F.col("i") + 1).cast("long").alias("ord"), "text")


DUCK_LINES = f"SELECT doc_id, (ord - 1) // {LINES_A_PAGE} + 1 AS page_number, ord, text FROM (SELECT doc_id, CAST(generate_subscripts(s, 1) AS BIGINT) AS ord, unnest(s) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))"

ADAPTERS = {"elements": (page_elements, "pages"), "lines": (document_lines, "documents")}


def duck_tables(names: tuple[str, ...]) -> dict[str, str]:
    """DuckDB SQL of the adapted and derived ones among ``names``, what they need first."""
    own = {"elements": _duck_elements(), "lines": DUCK_LINES}
    out: dict[str, str] = {}
    for name in names:
        if name in DERIVED:
            needs, sql = DERIVED[name]
            out |= duck_tables(needs) | {name: sql(DUCK)}
        elif name in own:
            out[name] = own[name]
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, an adapted or a derived one."""
    if name in DERIVED:
        needs, sql = DERIVED[name]
        return spark.sql(sql(SPARK), **{n: table(spark, sf_dir, n) for n in needs})
    if name in ADAPTERS:
        adapt, source = ADAPTERS[name]
        return adapt(load(spark, sf_dir, source))
    return load(spark, sf_dir, name)
