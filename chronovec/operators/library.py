"""Records of a library: scenes with files, markers, tags and people.

Null arrays count as empty. Scenes keep their identity in ``scene_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovec.functions.names import short_number


def markers_by_tag(scenes: DataFrame, tag: str) -> DataFrame:
    """Markers that carry a tag, by scene; an end of 0 is none.

    scenes(scene_id, markers: array of marker_id, seconds, end_seconds, title, tags).
    """
    found = F.filter("markers", lambda m: F.array_contains(m["tags"], tag))
    rows = scenes.select("scene_id", F.explode(found).alias("m"))
    return rows.select(
        "scene_id", F.col("m.marker_id").alias("marker_id"), F.coalesce("m.seconds", F.lit(0.0)).alias("seconds"),
        F.when(F.col("m.end_seconds") != 0, F.col("m.end_seconds")).alias("end_seconds"), F.coalesce("m.title", F.lit("")).alias("title"),
    ).orderBy("scene_id", "marker_id")


def without_markers(markers: DataFrame, ids: DataFrame) -> DataFrame:
    return markers.join(ids.select("marker_id").distinct(), "marker_id", "left_anti")


# Fields of a scene's record besides title, studio and people, with their types and defaults, and fields of its first file.
FIELDS = [("date", "string", ""), ("details", "string", ""), ("rating", "int", None), ("count", "long", 0), ("organized", "boolean", False), ("cover", "string", None)]
FILE_FIELDS = [("duration", "double"), ("width", "int"), ("height", "int"), ("path", "string")]
# Fields of a scene that may be changed.
EDITABLE = ["rating", "organized", "title", "date", "details"]


def scene_details(scenes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Flat display records of the wanted scene_ids: nulls to defaults, people with and without ids, tags, the first file.

    Columns and fields of files that scenes lack count as null.
    """
    first = F.try_element_at("files", F.lit(1))
    known = scenes.schema["files"].dataType.elementType
    names = lambda c: F.coalesce(F.transform(c, lambda p: F.coalesce(p["name"], F.lit(""))), F.array().cast("array<string>"))
    person = lambda p: F.struct(p["id"].cast("string").alias("id"), F.coalesce(p["name"], F.lit("")).alias("name"))
    own = lambda c, kind: F.col(c).cast(kind) if c in scenes.columns else F.lit(None).cast(kind)
    return scenes.join(wanted.select("scene_id").distinct(), "scene_id", "left_semi").select(
        "scene_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("studio", F.lit("")).alias("studio"), names("people").alias("people"),
        F.coalesce(F.transform("people", person), F.array().cast("array<struct<id:string,name:string>>")).alias("people_detail"),
        F.coalesce(own("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        *(F.coalesce(own(c, kind), F.lit(default).cast(kind)).alias(c) for c, kind, default in FIELDS),
        *(first[c].cast(kind).alias(c) if c in known.names else F.lit(None).cast(kind).alias(c) for c, kind in FILE_FIELDS),
    )


def scene_count(scenes: DataFrame) -> DataFrame:
    return scenes.agg(F.countDistinct("scene_id").alias("scenes"))


def update_scenes(scenes: DataFrame, changes: DataFrame) -> DataFrame:
    """scenes after changes(scene_id, some of EDITABLE), one row a scene; null leaves a field as it is, unknown scenes are ignored."""
    fields = [c for c in changes.columns if c != "scene_id"]
    if odd := sorted(set(fields) - set(EDITABLE)):
        raise ValueError(f"{', '.join(odd)} can't be changed")
    new = changes.select("scene_id", *(F.col(c).alias(f"new_{c}") for c in fields))
    rows = scenes.join(new, "scene_id", "left")
    return rows.withColumns({c: F.coalesce(f"new_{c}", c) for c in fields}).select(scenes.columns)


def scenes_with(scenes: DataFrame, person: Column | int | str) -> DataFrame:
    """scene_ids in which a person appears."""
    return scenes.where(F.exists("people", lambda p: p["id"] == person)).select("scene_id").distinct()


def find_people(scenes: DataFrame, pattern: str | None = None) -> DataFrame:
    """id, name and number of scenes of people whose name matches a pattern; without one, of all."""
    rows = scenes.select("scene_id", F.explode("people").alias("p")).select("scene_id", "p.id", "p.name")
    if pattern is not None:
        rows = rows.where(F.col("name").rlike(pattern))
    return rows.groupBy("id", "name").agg(F.countDistinct("scene_id").alias("scene_count"))


def find_or_create_tags(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """tags(id, name) with the wanted names that were missing; a new id follows from the name."""
    names = wanted.select("name").where("name IS NOT NULL").distinct()
    new_id = F.concat(F.lit("tag-"), F.substring(F.sha1(F.col("name").cast("binary")), 1, 16))
    return tags.join(names, "name", "full_outer").select(F.coalesce(F.col("id"), new_id).alias("id"), "name", F.col("id").isNull().alias("created"))


def change_tags(scenes: DataFrame, changes: DataFrame, mode: str = "add") -> DataFrame:
    """scenes(scene_id, tags) after changes(scene_id, tag), one row a tag: add, set or remove.

    Scenes without changes stay as they are, and changes of unknown scenes are ignored.
    """
    own = changes.where("tag IS NOT NULL").groupBy("scene_id").agg(F.sort_array(F.collect_set("tag")).alias("changed"))
    before = F.coalesce("tags", F.array().cast("array<string>"))
    after = {"add": F.array_union(before, "changed"), "set": F.col("changed"), "remove": F.array_except(before, "changed")}[mode]
    rows = scenes.join(own, "scene_id", "left")
    return rows.withColumn("tags", F.when(F.col("changed").isNull(), F.col("tags")).otherwise(after)).drop("changed")


def stream_url(base: str, scene_id: Column, start: Column, key: str | None = None) -> Column:
    """Address of a scene's stream, from a start where there is one."""
    parts = F.array_compact(F.array(F.concat(F.lit("start="), short_number(start)), F.lit(f"apikey={key}" if key else None).cast("string")))
    url = F.concat(F.lit(base.rstrip("/") + "/scene/"), scene_id.cast("string"), F.lit("/stream"))
    return F.when(F.size(parts) == 0, url).otherwise(F.concat(url, F.lit("?"), F.array_join(parts, "&")))


def tag_named(tags: DataFrame, name: str) -> DataFrame:
    """The tag of exactly this name, that with the smallest id if it is listed twice; no row if there is none."""
    return tags.where(F.col("name") == name).groupBy("name").agg(F.min("id").alias("id")).select("id", "name")
