"""Pages: tokens of HTML, origins, questions, capture gate (P16 in part, P22, P24, P26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import WIDE

TOKENS = r"(?s)(<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]+>|[^<]+)"
#: Tags that ``with_depth`` passes over: those without content, and those often left open. The tree proper is ``tree``'s.
FLAT = "area base br col embed hr img input link meta source track wbr p li b i em strong".split()
# How a question begins.
QUESTIONS = ["what", "which", "who", "whose", "where", "when", "why", "how", "is ", "are ", "was ", "were ", "do ", "does ", "did ", "can ", "could ", "find ", "list ", "tell ", "summarise", "summarize", "explain"]


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, seq, kind (open, close, text, skip), tag and text of every token, in page order."""
    cut = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TOKENS), F.lit(1))).alias("seq", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^</?\s*([A-Za-z][A-Za-z0-9-]*)", 1))
    kind = F.when(F.col("raw").rlike(r"(?is)^<(!|\?|script\b|style\b)"), "skip").when(F.col("raw").rlike("^</"), "close").when(F.col("raw").rlike("^<[A-Za-z]"), "open").otherwise("text")
    text = F.when(kind == "text", F.trim(F.regexp_replace("raw", r"\s+", " ")))
    return cut.select("page_id", "seq", kind.alias("kind"), tag.alias("tag"), text.alias("text"))


def capturable(pages: DataFrame, captured: DataFrame | None = None, least: int = 100) -> DataFrame:
    """page_id and nodes (opening tags) of pages with ``least`` nodes or more whose url is not among those of ``captured``."""
    fresh = pages.join(captured.select("url").distinct(), "url", "left_anti") if captured is not None else pages
    return tokens(fresh).where("kind = 'open'").groupBy("page_id").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") >= least)


def with_depth(found: DataFrame) -> DataFrame:
    """Depth at each token; tags in FLAT add none. A page that ends at 0 closes what it opens."""
    from pyspark.sql import Window

    step = F.when(F.col("tag").isin(FLAT), 0).when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    return found.withColumn("depth", F.sum(step).over(Window.partitionBy("page_id").orderBy("seq")))


def origin(url: Column) -> Column:
    """Scheme, host and port without default ports; about:blank where there is none."""
    scheme, host = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    port = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)", 1)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    return F.when((scheme == "") | (host == ""), "about:blank").otherwise(F.concat(scheme, F.lit("://"), host, shown))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; one that ends in such a segment ends in a slash."""
    parts = F.split(path, "/")
    begin = F.array().cast("array<string>")
    step = lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(x)))
    kept = F.aggregate(parts, begin, step)
    return F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))


#: scheme with its colon, host with port, path, query and fragment of a URL.
URL = "^([A-Za-z][A-Za-z0-9+.-]*:)//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)([?][^#]*)?(#.*)?$"


def resolved(rows: DataFrame, url: str, reference: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the absolute URL of a reference on a page: one with a scheme as it is, ``//host`` under the page's scheme, a path without
    its dots, a query or a fragment under the page's origin. Blanks around it don't count, backslashes are slashes. Null where a URL without host would be needed."""
    part = lambda k: F.regexp_extract(url, URL, k)
    ref = F.regexp_replace(F.trim(F.regexp_replace(F.col(reference), r"[\t\n\r]", "")), r"\\", "/")
    rows = rows.withColumn("__ref", ref).withColumn("__head", F.nullif(F.concat(part(1), F.lit("//"), part(2)), F.lit("//"))).withColumn("__path", F.coalesce(F.nullif(part(3), F.lit("")), F.lit("/")))
    rows = rows.withColumn("__rest", F.regexp_extract("__ref", "[?#].*$", 0)).withColumn("__to", F.regexp_extract("__ref", "^[^?#]*", 0))
    path = F.when(F.col("__to") == "", F.col("__path")).when(F.startswith("__to", F.lit("/")), F.col("__to")).otherwise(F.concat(F.regexp_replace("__path", "[^/]*$", ""), F.col("__to")))
    rows = rows.withColumn("__full", path)
    query = F.when((F.col("__to") == "") & ~F.startswith("__rest", F.lit("?")), part(4)).otherwise("")
    under = F.when(F.startswith("__ref", F.lit("//")), F.concat(part(1), F.col("__ref"))).otherwise(F.concat("__head", without_dots(F.col("__full")), query, "__rest"))
    out = F.when(F.col("__ref").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("__ref")).when(F.col("__head").isNotNull(), under)
    return rows.withColumn(name, out).drop("__ref", "__head", "__path", "__rest", "__to", "__full")


def is_question(goal: Column) -> Column:
    """P26."""
    g = F.regexp_replace(F.lower(goal), rf"^[\s{WIDE}]+|[\s{WIDE}]+$", "")
    out = F.endswith(g, F.lit("?"))
    for q in QUESTIONS:
        out = out | F.startswith(g, F.lit(q))
    return F.coalesce(out, F.lit(False))
