"""Source files as tables: which files there are, their languages and contents.

Files are read by Spark, so a workspace can be in any store that Spark reads.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import ship_library

LARGEST_FILE = 4 * 1024 * 1024
SNIFFED_BYTES = 8 * 1024
IGNORE_FILES = (".gitignore", ".loomgraphignore")
EXCLUDE_FILE = ".git/info/exclude"
# Languages by file extension.
EXTENSIONS = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "scala": "scala", "sc": "scala",
    "swift": "swift", "lua": "lua",
}
_CPP_ONLY = r"(?m)^\s*(class\s+\w+|namespace\s+\w+|template\s*<|using\s+namespace|public:|private:|protected:)|\bstd::|#include\s*<(iostream|vector|string|memory|map)>"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, bytes, content) of all files below the root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bare = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = re.sub("^[a-z]+:/*", "/", root.rstrip("/"))
    relative = F.substring(bare, len(base) + 2, 1 << 30)
    return found.select(bare.alias("path"), relative.alias("relative"), F.col("length").alias("bytes"), "content")


def ignore_lists(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Lines of the ignore files that hold below the root, by folder. Spark's readers pass over such files, so Hadoop's do it.

    Inside a git repository, its exclude file and the ignore files of the folders above the root count too;
    a folder above is named by `..` for each step up, and what leads from it to the root.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    child = lambda folder, name: jvm.org.apache.hadoop.fs.Path(folder, name)

    def lines(path) -> list[str]:
        stream = system.open(path)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()

    top = system.makeQualified(top)
    prefix, found, listed = top.toString().rstrip("/"), {}, system.listFiles(top, True)
    above, folder, steps, way = {}, top, 0, ""
    while folder is not None:  # up to the repository's folder
        key = "/".join([".."] * steps) + (f"/{way}" if way else "")
        own = [n for n in IGNORE_FILES if steps and system.exists(child(folder, n))]
        above = {key: [line for n in own for line in lines(child(folder, n))]} | above if own else above
        if system.exists(child(folder, ".git")):
            exclude = child(folder, EXCLUDE_FILE)
            if system.exists(exclude):
                above = {key: lines(exclude) + above.get(key, [])} | {k: v for k, v in above.items() if k != key}
            found = above
            break
        way, steps, folder = f"{folder.getName()}/{way}".strip("/"), steps + 1, folder.getParent()
    while listed.hasNext():
        path = listed.next().getPath()
        if path.getName() in IGNORE_FILES:
            inside = path.getParent().toString().removeprefix(prefix).strip("/")
            found.setdefault(inside, []).extend(lines(path))
    return found


def is_hidden(relative: Column) -> Column:
    return relative.rlike(r"(^|/)\.")


def ignore_test(patterns: dict[str, list[str]]) -> Callable[[str], bool]:
    """Whether ignore files (folder -> lines) leave a path out; the last line that matches decides, ! takes back."""
    rules = []
    depth = lambda folder: -folder.split("/").count("..") or (folder != "") + folder.count("/")
    for folder, lines in sorted(patterns.items(), key=lambda x: depth(x[0])):
        for line in (raw.rstrip() for raw in lines):
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            anchored = "/" in line.rstrip("/")
            rules.append((folder, line.strip("/"), keep, anchored, line.endswith("/")))

    def ignored(path: str) -> bool:
        out = False
        parts = path.split("/")
        for folder, pattern, keep, anchored, only_folders in rules:
            inside = folder.split("/") if folder else []
            if inside[:1] == [".."]:  # a folder above the root: what leads from there to the root stands before the path
                rest = [p for p in inside if p != ".."] + parts
            elif parts[: len(inside)] != inside:
                continue
            else:
                rest = parts[len(inside) :]
            ends = range(1, len(rest) + (0 if only_folders else 1))
            names = ["/".join(rest[:i]) for i in ends] if anchored else [rest[i - 1] for i in ends]
            if any(fnmatch.fnmatchcase(n, pattern) for n in names):
                out = not keep
        return out

    return ignored


def language_of(relative: Column, content: Column, headers: str | None = None) -> Column:
    """The language by extension. A .h file is what `headers` says, or C++ if its first 8 KiB use what C lacks."""
    extension = F.lower(F.regexp_extract(relative, r"\.([A-Za-z]+)$", 1))
    names = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    start = F.try_to_binary(F.lit(""), F.lit("utf-8")) if content is None else F.substring(content, 1, SNIFFED_BYTES)
    sniffed = F.when(F.lit(headers is not None), F.lit(headers)).when(start.cast("string").rlike(_CPP_ONLY), F.lit("cpp")).otherwise(F.lit("c"))
    return F.when(extension == "h", sniffed).otherwise(names[extension])


def files(spark: SparkSession, root: str, headers: str | None = None, languages: tuple[str, ...] = ()) -> DataFrame:
    """(path, relative, language, bytes, content, status): known, unignored files.

    status is `ok`, or `skipped` for files of 4 MiB and more or that are not UTF-8.
    """
    rows = scan(spark, root)
    patterns = ignore_lists(spark, root)
    ignored = ignore_test(patterns)

    @F.pandas_udf("boolean")
    def left_out(paths):
        return paths.map(ignored)

    known = rows.filter(~is_hidden(F.col("relative"))).withColumn("language", language_of(F.col("relative"), F.col("content"), headers))
    known = known.filter("language is not null")
    if languages:
        known = known.filter(F.col("language").isin(*languages))
    if patterns:
        ship_library(spark)
        known = known.filter(~left_out("relative"))
    readable = (F.col("bytes") < LARGEST_FILE) & F.is_valid_utf8(F.col("content").cast("string"))
    return known.withColumn("status", F.when(readable, "ok").otherwise("skipped"))


def parsed(found: DataFrame, rules: tuple = ()) -> DataFrame:
    """(path, result): what the language's parser makes of each readable file, as JSON; files that fail give no row."""
    from loomgraph.sources import parsers

    ship_library(found.sparkSession)
    parse = parsers.parse_json
    rows = found.filter("status = 'ok'").select("path", "language", F.col("content").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            paths, results = [], []
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                result = parse(path, language, text, rules)
                if result is not None:
                    paths.append(path)
                    results.append(result)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(results, pa.string())], names=["path", "result"])

    return rows.mapInArrow(run, "path string, result string")


def parse_tables(found: DataFrame, rules: tuple = ()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parsed symbols, chains and calls with file-local ids, and the files that were parsed.

    rules: effect rules of one's own, before the default ones.
    """
    from loomgraph import schema
    from loomgraph.session import materialize

    rows = materialize(parsed(found, rules))
    ddl = lambda kind: f"array<struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in kind.fields)}>>"
    whole = f"symbols {ddl(schema.SYMBOLS)}, chains {ddl(schema.CHAINS)}, calls {ddl(schema.CALL_RECORDS)}"
    nested = rows.select("path", F.from_json("result", whole).alias("r"))
    tables = [nested.select("path", F.explode(f"r.{name}").alias("x")).select("path", "x.*") for name in ("symbols", "chains", "calls")]
    text = F.col("content").cast("string")
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")
    files_table = found.join(rows.select("path"), "path", "left_semi").select("path", "language", "bytes", lines.alias("lines"))
    return (*tables, files_table)


def skipped(found: DataFrame) -> int:
    return found.filter("status = 'skipped'").count()
