"""Fill-in-middle transformation in Spark SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a word with the white space before it, or white space that no word follows: units joined give the text.
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINEL = "<[PSM]>"
#: What transformed() adds.
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def _draw(k: int) -> Column:
    """The k-th group of eight hexadecimal digits of digest, as a number."""
    return F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")


def _joined(begin: Column, length: Column) -> Column:
    return F.array_join(F.slice("units", begin + 1, length), "")


def transformed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """Adds n (units of the text), form, prefix_chars, middle_chars and output, the text arranged by its form.

    rate in a hundred of the texts are cut at two units, drawn from the sha256 of the seed and the id, of which spm_rate in a
    hundred put the suffix first (spm), the others the prefix (psm). A text that is empty or holds a sentinel stays
    plain, as do the others; its prefix_chars and middle_chars are null. A null text is an empty one, a null id an empty
    string; equal rows get equal outputs. Columns of df that have an added column's name are replaced, others stay.
    Row by row, whole texts, no shuffle; a row's units are held at once.
    """
    text = F.coalesce(F.col("_row")[text_col], F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_row")[id_col].cast("string"), F.lit("")))
    rows = df.select(F.struct(*[F.col(_quoted(c)) for c in df.columns]).alias("_row"))
    rows = rows.select("_row", text.alias("plain"), F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)).alias("units"), F.sha2(key, 256).alias("digest"))
    rows = rows.withColumn("n", F.size("units").cast("long"))
    cuts = [F.pmod(_draw(k), F.col("n") + 1).cast("int") for k in (0, 1)]
    plain = (F.col("n") == 0) | F.col("plain").rlike(_SENTINEL) | (_draw(2) % 100 >= rate)
    rows = rows.withColumns({"a": F.least(*cuts), "b": F.greatest(*cuts), "form": F.when(plain, "plain").when(_draw(3) % 100 < spm_rate, "spm").otherwise("psm")})
    cut = F.struct(_joined(F.lit(0), F.col("a")).alias("prefix"), _joined(F.col("a"), F.col("b") - F.col("a")).alias("middle"), _joined(F.col("b"), F.size("units") - F.col("b")).alias("suffix"))
    rows = rows.withColumn("cut", F.when(F.col("form") != "plain", cut))
    p, m, s = (F.col(f"cut.{c}") for c in ("prefix", "middle", "suffix"))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    added = {"n": F.col("n"), "form": F.col("form"), "prefix_chars": F.char_length(p).cast("long"), "middle_chars": F.char_length(m).cast("long"), "output": F.coalesce(output, F.col("plain"))}
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c.lower() not in ADDED]
    return rows.select(*kept, *[added[c].alias(c) for c in ADDED])


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form", out: str = "restored") -> DataFrame:
    """Adds out (or replaces it): the text that output_col was made of.

    A text with sentinels of its own is plain, so the three sentinels of an arranged one part it without doubt.
    """
    output, form = F.col(_quoted(output_col)), F.col(_quoted(form_col))
    first = F.when(form == "psm", 1).otherwise(2)  # where the prefix stands; the suffix has the other place
    joined = F.transform(F.array(F.split(output, _SENTINEL, -1)), lambda parts: F.concat(F.get(parts, first), F.get(parts, F.lit(3)), F.get(parts, 3 - first)))[0]
    return df.withColumn(out, F.when(form == "plain", output).otherwise(joined))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op11(spark, sf_dir: str) -> DataFrame:
    """Every document arranged for filling in its middle, and restored from that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = restored(transformed(docs).drop("text"))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
