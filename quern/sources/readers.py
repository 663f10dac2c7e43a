"""Sources: tables, documents, logs, bytes and generators, all through Spark's readers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quern.functions import text as T


def first_rows(spark: SparkSession, path: str, columns: list[str], order: str, n: int) -> DataFrame:
    """A few columns, the first n rows by an explicit order (files have none)."""
    return spark.read.parquet(path).select(*columns).orderBy(order).limit(n)


def until_bytes(df: DataFrame, text: str, order: str, cap: int, part: str | None = None) -> DataFrame:
    """Rows in order until their bytes reach the cap; the row that crosses it is kept. Runs per `part` when given."""
    w = Window.partitionBy(*([part] if part else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(F.octet_length(text)).over(w), F.lit(0))).where(F.col("_before") < cap).drop("_before")


def capped_fetch(df: DataFrame, text: str, order: str, cap: int, least: int = 200, part: str | None = None) -> DataFrame:
    """Long enough rows until the cap."""
    return until_bytes(df.where(F.length(text) >= least), text, order, cap, part)


def overflow_split(df: DataFrame, text: str, order: str, train_cap: int, eval_cap: int, part: str) -> DataFrame:
    """train until its cap, then eval until its own, then nothing."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length(text)).over(w), F.lit(0))
    return df.withColumn("split", F.when(before < train_cap, "train").when(before < train_cap + eval_cap, "eval")).where("split is not null")


def positional_split(df: DataFrame, order: str, part: str, share: float = 0.8) -> DataFrame:
    """The first share of rows (one at least) for training."""
    i = F.row_number().over(Window.partitionBy(part).orderBy(order))
    n = F.count("*").over(Window.partitionBy(part))
    return df.withColumn("split", F.when(i <= F.greatest(F.lit(1), F.floor(share * n)), "train").otherwise("eval"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line of all non-blank lines of text files."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line")).where(T.strip(F.col("line")) != "")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON under a declared schema; nothing is inferred."""
    return spark.read.schema(schema).json(path, multiLine=True)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


# The run-log line's form.
DONE_LINE = r"\[([\w.-]+)\] done: val ([\d.]+) · ([\d,]+) tok/s · ([\d,.]+) MiB peak"


def parse_run_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """tag, val, tokens_per_second, peak_mib of all `done` lines."""
    part = lambda i: F.regexp_extract(line, DONE_LINE, i)
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).cast("double")
    hits = lines.where(F.col(line).rlike(DONE_LINE))
    return hits.select(part(1).alias("tag"), number(part(2)).alias("val"), number(part(3)).alias("tokens_per_second"), number(part(4)).alias("peak_mib"))


# -- HTML ------------------------------------------------------------------------------------------------------------


def strip_noise(html: Column) -> Column:
    """Without scripts, styles, comments and meta tags; category links become lines of text."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r'(?is)<link[^>]*rel="mw:PageProp/Category"[^>]*href="([^"]*)"[^>]*>', "\n$1\n")
    return F.regexp_replace(c, r"(?is)<(meta|link)\b[^>]*>", "")


def absolute_url(link: Column, base: str, host: str) -> Column:
    """// gets a scheme, ./ the base, / the host."""
    return (
        F.when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("./"), F.concat(F.lit(base), F.substr(link, F.lit(3))))
        .when(link.startswith("/"), F.concat(F.lit(host), link))
        .otherwise(link)
    )


def tidy_markdown(c: Column) -> Column:
    """No-break spaces to spaces, four and more newlines to three, no blanks before newlines, one newline at the end."""
    c = F.regexp_replace(c, " ", " ")
    c = F.regexp_replace(c, r"\n{4,}", "\n\n\n")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    return F.concat(T.strip(c), F.lit("\n"))


def markdown_udf(base: str = "", host: str = ""):
    """Headings, bullets, links and paragraphs as Markdown, by the standard parser."""

    @pandas_udf(StringType())
    def convert(pages):
        from html.parser import HTMLParser

        class Writer(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.out, self.quiet, self.link = [], 0, []

            def handle_starttag(self, tag, attrs):
                if tag in ("script", "style", "head"):
                    self.quiet += 1
                elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                    self.out.append("\n\n" + "#" * int(tag[1]) + " ")
                elif tag == "li":
                    self.out.append("\n- ")
                elif tag in ("p", "div", "article", "nav", "ul", "footer"):
                    self.out.append("\n\n")
                elif tag == "br":
                    self.out.append("\n")
                elif tag == "a":
                    to = dict(attrs).get("href") or ""
                    self.link.append("https:" + to if to.startswith("//") else base + to[2:] if to.startswith("./") else host + to if to.startswith("/") else to)
                    self.out.append("[")

            def handle_endtag(self, tag):
                if tag in ("script", "style", "head"):
                    self.quiet = max(0, self.quiet - 1)
                elif tag == "a" and self.link:
                    self.out.append(f"]({self.link.pop()})")

            def handle_data(self, data):
                if not self.quiet:
                    self.out.append(data)

        def one(page):
            if page is None:
                return None
            w = Writer()
            w.feed(page)
            w.close()
            return "".join(w.out)

        return pages.map(one)

    return convert


# -- generators ------------------------------------------------------------------------------------------------------


def _uniform(seed: int, stream: int) -> Column:
    """Uniform in (0, 1) from a hash of the row's id: the same on every run and any partitioning."""
    return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(stream)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(seed: int, stream: int) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, 2 * stream))) * F.cos(2 * math.pi * _uniform(seed, 2 * stream + 1))


def rings(spark: SparkSession, n: int = 300, seed: int = 7) -> DataFrame:
    """Two noisy circles around each other."""
    label = F.pmod("id", F.lit(2)).cast("int")
    r = F.when(label == 0, 1.0).otherwise(2.5) + 0.15 * normal(seed, 1)
    a = 2 * math.pi * _uniform(seed, 9)
    return spark.range(n).select("id", (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"), label.alias("label"))


def moons(spark: SparkSession, n: int = 200, seed: int = 1, flipped: float = 0.1) -> DataFrame:
    """Two half circles; a share of labels is flipped."""
    label = F.pmod("id", F.lit(2)).cast("int")
    a = math.pi * _uniform(seed, 9)
    x = F.when(label == 0, F.cos(a)).otherwise(1 - F.cos(a)) + 0.1 * normal(seed, 1)
    y = F.when(label == 0, F.sin(a)).otherwise(0.5 - F.sin(a)) + 0.1 * normal(seed, 2)
    return spark.range(n).select("id", x.alias("x"), y.alias("y"), F.when(_uniform(seed, 11) < flipped, 1 - label).otherwise(label).alias("label"))


def grammar_pairs(spark: SparkSession, n: int = 800, seed: int = 3) -> DataFrame:
    """Neighbouring words of small sentences."""
    pick = lambda words, s: F.get(F.array(*map(F.lit, words)), F.floor(_uniform(seed, s) * len(words)).cast("int"))
    words = F.array(pick(["the", "a"], 1), pick(["cat", "dog", "bird"], 2), pick(["sees", "likes"], 3), pick(["the", "a"], 4), pick(["tree", "house"], 5))
    w = spark.range(n).select("id", words.alias("w"))
    return w.select("id", F.posexplode(F.slice("w", 1, 4)).alias("i", "input"), "w").select("id", "i", "input", F.get("w", F.col("i") + 1).alias("target"))
