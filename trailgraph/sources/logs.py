"""Readers of line-shaped records: commit logs, status lists, tickets, JSONL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailgraph.functions import scalar as S
from trailgraph.operators.gates import refuse_secrets


def read_text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content, ext, size, sha256 of every file below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = path.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(base), "")
    return reader.load(path).select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).withColumn("ext", S.suffix_of("path"))


def commit_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw commit records of a log written as `COMMIT:...` blocks: record.

    The header marker at a line's start is the record separator, so a log of any
    size splits across tasks and no line numbering is needed. Only the first
    record of a file still has its marker.
    """
    marked = F.when(F.col("value").startswith("COMMIT:"), F.col("value")).otherwise(F.concat(F.lit("COMMIT:"), "value"))
    return spark.read.option("lineSep", "\nCOMMIT:").text(path).filter(S.trim("value") != "").select(marked.alias("record"))


def parse_commits(records: DataFrame, column: str = "record") -> DataFrame:
    """sha, author, ts, subject, files from one `COMMIT:sha|author|date|subject`
    header and file lines per record. A bar in the subject cuts it; an
    unreadable date becomes the epoch."""
    lines = F.split(F.regexp_replace(column, r"^\s*COMMIT:", ""), "\n")
    head = F.split(lines[0], r"\|")

    def part(i: int):
        return S.trim(F.try_element_at(head, F.lit(i)))

    files = F.filter(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: S.trim(x)), lambda x: x != "")
    return records.select(
        F.coalesce(part(1), F.lit("")).alias("sha"), F.coalesce(part(2), F.lit("unknown")).alias("author"),
        F.coalesce(F.try_to_timestamp(part(3)), F.lit("1970-01-01").cast("timestamp")).alias("ts"), F.coalesce(part(4), F.lit("")).alias("subject"), files.alias("files"))


def commit_touches(commits: DataFrame) -> DataFrame:
    return commits.select("sha", "author", "ts", "subject", F.explode("files").alias("file")).withColumn("module", S.first_segment("file"))


def changed_paths(status_lines: DataFrame, column: str = "line", own_folder: str | None = None) -> DataFrame:
    """Source files named by short status lines: three columns are cut, a rename
    keeps its new name, quotes go. Other columns stay."""
    others = [c for c in status_lines.columns if c != column]
    p = S.trim(F.substr(F.col(column), F.lit(4)))
    p = F.when(p.contains(" -> "), F.element_at(F.split(p, " -> "), 2)).otherwise(p)
    p = F.regexp_replace(p, r'^"|"$', "")
    out = status_lines.select(*others, p.alias("path")).filter((F.col("path") != "") & F.col("path").rlike(S.SOURCE_SUFFIX))
    if own_folder:
        out = out.filter(~F.col("path").startswith(own_folder.rstrip("/") + "/"))
    return out.distinct()


def ticket_targets(tickets: DataFrame) -> DataFrame:
    """ticket, node_id pairs of `- Target (Graph) Nodes:` sections, listed
    inline or as bullets below. The section's text is cut out whole, up to the
    first line that ends it, then split."""
    # Section heading and the id kinds a bullet may hold.
    head = r"(?im)^[ \t]*-[ \t]*target[ \t]+(?:graph[ \t]+)?nodes:[ \t]*"
    bodies = F.slice(F.split("content", head), 2, 1 << 20)
    b = tickets.select("ticket", F.explode(bodies).alias("b"))
    inline = F.regexp_replace(F.substring_index("b", "\n", 1), r"[\[\]]", "")
    rest = F.regexp_extract("b", r"(?i)^[^\n]*((?:\n[ \t]*(?:[-*][ \t]*(?:(?:module|symbol|pkg|proposed):[^\n]*|[^:\n]*))?(?=\n|\z))*)", 1)
    bullets = F.transform(F.split(rest, "\n"), lambda x: S.trim(F.regexp_replace(S.trim(x), r"^[-*]\s*", "")))
    ids = F.concat(F.transform(F.split(inline, ","), lambda x: S.trim(x)), bullets)
    return b.select("ticket", F.explode(ids).alias("node_id")).filter("node_id <> ''").distinct()


def open_questions(docs: DataFrame) -> DataFrame:
    """Rows of Markdown question tables and check boxes: doc, id, question,
    owner, status, priority.

    A table begins at its `| # |` head and ends at the next heading; its ids are
    digits. A check box is numbered by its place among the document's items.
    """
    # Words that close a question, and words that make it block.
    closed, blocking = ["resolved", "closed", "done"], r"(?i)(blocking|critical|required|must|p0)"
    lines = docs.select("doc", F.posexplode(F.split("content", "\n")).alias("pos", "l")).withColumn("t", S.trim("l"))
    t = F.col("t")
    is_box = t.startswith("- [ ]") | t.startswith("- [x]")
    is_head = ~is_box & (t.startswith("| # |") | t.startswith("|#|"))
    order = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    inside = F.coalesce(F.last(F.when(is_head, True).when(~is_box & t.startswith("##"), False), True).over(order), F.lit(False))
    cells = F.filter(F.transform(F.split("t", r"\|"), lambda x: S.trim(x)), lambda x: x != "")
    cell = lambda i: F.coalesce(F.try_element_at(cells, F.lit(i)), F.lit(""))
    is_row = ~is_box & ~is_head & F.col("inside") & t.startswith("|") & ~t.contains("---") & (F.size(cells) >= 3) & cell(1).rlike(r"^[0-9]+$")
    text = F.when(is_box, S.trim(F.substr("t", F.lit(6)))).otherwise(cell(2))
    state = F.lower(F.when(cell(4) == "", "open").otherwise(cell(4)))
    is_closed = F.when(is_box, t.startswith("- [x]")).otherwise(state.contains(closed[0]) | state.contains(closed[1]) | state.contains(closed[2]))
    level = F.when(is_box, "").otherwise(F.lower(cell(5)))
    blocks = level.contains("p0") | level.contains("block") | text.rlike(blocking)
    items = lines.withColumn("inside", inside).filter(is_box | is_row).withColumn("nth", F.row_number().over(W.partitionBy("doc").orderBy("pos")))
    return items.select(
        "doc", F.when(is_box, F.col("nth").cast("string")).otherwise(cell(1)).alias("id"), text.alias("question"), F.when(~is_box, cell(3)).alias("owner"),
        F.when(is_closed, "resolved").otherwise("open").alias("status"), F.when(blocks, "blocking").otherwise("normal").alias("priority"))


EXPERIMENT = ("id string, goal string, hypothesis string, targetFile string, targetSymbol string, baselineValue double, measuredValue double, "
              "deltaPercent double, verdict string, revertReason string, flightId string, createdAt timestamp, closedAt timestamp, gitCommit string")


def experiments(spark: SparkSession, path: str, target_file: str | None = None) -> DataFrame:
    """Experiment ledger (JSON lines); unreadable lines are skipped."""
    df = spark.read.schema(EXPERIMENT).option("mode", "DROPMALFORMED").json(path)
    return df.filter(F.col("targetFile") == target_file) if target_file else df


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("sep", "\t").option("quoteAll", True).csv(path)


def workspace_hash(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One digest of a file set, whatever its order: the hash of the file count
    and of four sums over the hashes of 'path:sha256' lines.

    Sums combine before the shuffle, so no list of files is ever gathered; any
    changed, added or dropped file changes the digest. files: path, sha256.
    """
    h = F.sha2(F.concat_ws(":", "path", "sha256"), 256)
    lanes = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return files.select(*(by or []), h.alias("h")).groupBy(*(by or [])).agg(
        F.sha2(F.concat_ws(":", F.count("*").cast("string"), *lanes), 256).alias("digest"), F.count("*").alias("files"))


def write_protected(df: DataFrame, path: str, text_columns: list[str], mode: str = "overwrite") -> None:
    """Write a table unless one of its texts holds a secret."""
    for c in text_columns:
        refuse_secrets(df, c)
    df.write.mode(mode).parquet(path)


def source_snapshot(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """path, sha256 of text files, up to max_bytes if given. files: path, content, size."""
    return (files if max_bytes is None else files.filter(F.col("size") <= max_bytes)).select("path", F.sha2("content", 256).alias("sha256"))
