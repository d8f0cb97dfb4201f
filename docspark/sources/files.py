"""$file: JSON and CSV files as collections.

A JSON file holds one array of documents (or a document a line); extended forms such as
``{"$date": ...}`` become values.  Written JSON has a document a line, or with ``pretty`` each
document over several lines with ``indent`` blanks a level (4 unless given) and a blank line after it; such
files are read too.  CSV fields are read as strings, and nulls, documents and
arrays are written as ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _options(options: object) -> dict:
    if isinstance(options, str):
        return {"filename": options}
    if isinstance(options, dict) and options.get("filename"):
        return options
    raise ValueError("$file needs a file name, or a document with filename")


def _format(o: dict) -> str:
    kind = str(o.get("format") or o["filename"].rsplit(".", 1)[-1]).lower()
    if kind not in ("json", "csv"):
        raise ValueError(f"unknown file format {kind!r}: json or csv")
    return kind


#: Types that the extended forms stand for.
_EXTENDED = {"$oid": "string", "$guid": "string", "$date": "timestamp", "$numberLong": "bigint", "$numberDecimal": "decimal(38,18)"}


def decoded(col: Column, t: T.DataType) -> Column:
    """A column read from JSON, with extended forms as values."""
    if isinstance(t, T.StructType):
        if len(t.fields) == 1 and (name := t.fields[0].name) in _EXTENDED:
            return col.getField(name).cast(_EXTENDED[name])
        if len(t.fields) == 1 and t.fields[0].name == "$binary":
            return F.try_to_binary(col.getField("$binary"), F.lit("base64"))
        if not any(f.dataType.simpleString().find("$") >= 0 for f in t.fields):
            return col
        return F.when(col.isNotNull(), F.struct(*[decoded(col.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType) and "$" in t.elementType.simpleString():
        return F.transform(col, lambda x: decoded(x, t.elementType))
    return col


def read_file(spark: SparkSession, options: object) -> DataFrame:
    o = _options(options)
    encoding = o.get("encoding", "UTF-8")
    if _format(o) == "json":
        start = spark.read.text(o["filename"]).filter("trim(value) <> ''").limit(1).collect()
        # an array spans lines; Spark's own files have a document a line, which many tasks can read
        whole = not start or start[0][0].strip() == "[" or not start[0][0].strip().endswith("}")
        pretty = bool(start) and start[0][0].rstrip() == "{"  # documents over several lines, a blank line after each
        df = spark.read.json(o["filename"], lineSep="\n\n", encoding=encoding) if pretty else spark.read.json(o["filename"], multiLine=whole, encoding=encoding)
        return df.select(*[decoded(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    header = o.get("header")
    names = header if isinstance(header, list) else None
    df = spark.read.csv(o["filename"], sep=o.get("delimiter", ","), header=names is None, inferSchema=False, encoding=encoding, multiLine=True, escape='"')
    return df.toDF(*names) if names else df


def write_file(df: DataFrame, options: object) -> int:
    """Write ``df`` as a folder of part files; the count of its rows."""
    o = _options(options)
    mode = "overwrite" if o.get("overwritten") else "errorifexists"
    if _format(o) == "json" and o.get("pretty"):
        columns = [F.col(f"`{f.name}`") for f in df.schema.fields]
        text = F.to_json(F.struct(*columns), {"pretty": "true", "ignoreNullFields": "false"})
        n = int(o.get("indent", 4))
        if n != 2:  # two blanks a level are written
            text = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.repeat(F.lit(" "), ((F.length(x) - F.length(F.ltrim(x))) / 2 * n).cast("int")), F.ltrim(x))), "\n")
        df.select(F.concat(text, F.lit("\n")).alias("value")).write.mode(mode).text(o["filename"])
    elif _format(o) == "json":
        df.write.mode(mode).json(o["filename"], encoding=o.get("encoding", "UTF-8"), ignoreNullFields=False)
    else:
        plain = [F.lit("null").alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
        header = o.get("header", True)
        df.select(*plain).write.mode(mode).csv(o["filename"], sep=o.get("delimiter", ","), header=header if isinstance(header, bool) else True, encoding=o.get("encoding", "UTF-8"), nullValue="null", escape='"')
    return df.count()
