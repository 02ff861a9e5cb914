"""Links and tables inside notes: wiki links, mentions, profiles, requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.functions import scalar as S
from trailgraph.functions.ranking import number_rows


def vault_links(docs: DataFrame) -> DataFrame:
    """Links between notes: [[wiki links]] by file stem, else file names
    mentioned in the text; one per unordered pair, wiki links first.

    Mentions are found by cutting file-name tokens out of each text and joining
    them to the names, never by trying every pair. docs: path, content.
    """
    names = docs.select(F.col("path").alias("target"), S.basename("path").alias("name"))
    stems = names.groupBy(F.lower(F.regexp_replace("name", r"\.md$", "")).alias("stem")).agg(F.max("target").alias("target"))
    wiki = docs.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"\[\[([^\]|#]+)"), F.lit(1))).alias("w")).select("path", F.lower(S.trim("w")).alias("stem")).join(stems, "stem").select(
        "path", "target", F.lit(0).alias("rank"))
    said = docs.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([\w.\-]+\.md)"), F.lit(1)))).alias("name"))
    mention = said.join(names, "name").select("path", "target", F.lit(1).alias("rank"))
    links = wiki.unionByName(mention).filter(F.col("path") != F.col("target"))
    g = links.groupBy(F.least("path", "target").alias("a"), F.greatest("path", "target").alias("b")).agg(F.min("rank").alias("rank"))
    return g.select("a", "b", F.when(F.col("rank") == 0, "wikilink").otherwise("mentions").alias("kind"))


def name_mentions(docs: DataFrame) -> DataFrame:
    """Documents naming another document's id in their text: id, depends_on.
    docs: id, content. Ids are matched as whole words."""
    words = docs.select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z0-9][\w\-]*)"), F.lit(1)))).alias("depends_on"))
    return words.filter(F.col("id") != F.col("depends_on")).join(docs.select(F.col("id").alias("depends_on")), "depends_on", "left_semi").select("id", "depends_on")


def profile_fields(profiles: DataFrame) -> DataFrame:
    """Saved author profiles back into fields: other columns, sessions, tests, depth."""
    others = [c for c in profiles.columns if c != "content"]

    def row(name: str):
        found = S.trim(F.regexp_extract("content", rf"\|\s*{name}\s*\|\s*([^|\n]+)\|", 1))
        return F.when(found == "", "unknown").otherwise(found)

    sessions = F.coalesce(F.regexp_extract("content", r"sessions:\s*(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    return profiles.select(*others, sessions.alias("sessions"), row("Tests").alias("tests"), row("Implementation depth").alias("depth"))


def number_requirements(requirements: DataFrame) -> DataFrame:
    """Frozen requirements numbered inside their topic by ord."""
    return number_rows(requirements, ["topic"], "ord", "position")


def next_id(ids: DataFrame, column: str = "id", prefix: str = "CLM-") -> DataFrame:
    """Following claim id: highest number plus one, four digits or more."""
    n = F.max(F.regexp_extract(column, rf"^{prefix}(\d+)$", 1).try_cast("bigint"))
    follow = (F.coalesce(n, F.lit(0)) + 1).cast("string")
    return ids.agg(F.concat(F.lit(prefix), F.when(F.length(follow) < 4, F.lpad(follow, 4, "0")).otherwise(follow)).alias("next_id"))
