"""String expressions: keys, profiles, file-name formats, filter strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of fisheye lenses with their field of view, in order of precedence.
FISHEYE_FOV = [("mkx200", 200.0), ("mkx220", 220.0), ("vrca220", 220.0), ("rf52", 190.0), ("fisheye190", 190.0), ("fisheye", 180.0)]
# Tokens of stereo layouts, in order of precedence.
LAYOUTS = [("sbs", "sbs"), ("lr", "sbs"), ("tb", "tb"), ("ou", "tb"), ("mono", "mono")]
# Aspect ratios from which frames are side by side, and up to which top-bottom.
WIDE, TALL = 1.5, 1.1


def safe_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, r"[^\p{L}\p{N}_-]", "_")


def resolve_profile(base: Column, category: Column) -> Column:
    """base, or base:category where the category isn't blank."""
    named = F.trim(F.coalesce(category, F.lit("")))
    return F.when(named == "", base).otherwise(F.concat(base, F.lit(":"), safe_tag(named)))


def base_profile(profile: Column) -> Column:
    return F.substring_index(profile, ":", 1)


def in_family(profile: Column, base: str) -> Column:
    return (profile == base) | profile.startswith(base + ":")


def path_key(path: Column) -> Column:
    return F.concat(F.lit("path-"), F.substring(F.sha1(path.cast("binary")), 1, 16))


def scene_key(fingerprints: Column, path: Column, scene_id: Column) -> Column:
    """First non-empty of oshash, md5, phash and any fingerprint; else the key of the path or id."""
    first = [F.nullif(F.try_element_at(fingerprints, F.lit(k)), F.lit("")) for k in ("oshash", "md5", "phash")]
    some = F.try_element_at(F.filter(F.map_values(fingerprints), lambda x: x != ""), F.lit(1))
    return F.coalesce(*first, some, path_key(F.coalesce(F.nullif(path, F.lit("")), scene_id)))


def under_path(path: Column, base: str) -> Column:
    base = base.rstrip("/")
    return (path == base) | path.startswith(base + "/")


def display_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t != ""))


def interval_signature(mode: Column, interval: Column) -> Column:
    """What a sampling setting is known by: -1 for keyframes, -(100 + interval) for sparse, else the interval."""
    return F.when(mode == "keyframes", F.lit(-1.0)).when(mode == "sparse", -(interval + 100.0)).otherwise(interval)


def wants_raw(mode: Column, pipeline: Column) -> Column:
    return (mode == "sparse") | ((mode == "interval") & (pipeline == "raw"))


# Fixed values in the two functions that build names for other programs: the namespaces of stored vectors here, and
# the words of the filter graph in dewarp_filter.
def model_namespace(model: Column) -> Column:
    """Namespace of a model variant; the smallest variants keep the short names."""
    dino = F.when(model.isin("dinov2_vits14", "dinov2"), F.lit("dinov2")).otherwise(
        F.concat(F.lit("dinov2-"), F.replace(F.replace(model, F.lit("dinov2_"), F.lit("")), F.lit("_"), F.lit("-")))
    )
    slug = F.replace(F.replace(F.lower(model), F.lit("/"), F.lit("-")), F.lit(" "), F.lit(""))
    clip = F.when(model == "ViT-B-32", F.lit("clip")).otherwise(F.concat(F.lit("clip-"), slug))
    return F.when(F.lower(model).startswith("dino"), dino).otherwise(clip)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once for each row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _named(name: Column) -> Column:
    """STRUCT projection, layout, fov (null: unknown) and confidence from tokens of a name."""

    def found(words: Column) -> Column:
        has = lambda t: F.array_contains(words, t)
        return F.struct(
            F.coalesce(*(F.when(has(t), F.lit(v)) for t, v in FISHEYE_FOV)).alias("fish"),
            F.when(has("180"), F.lit(180.0)).when(has("360"), F.lit(360.0)).alias("angle"),
            F.coalesce(*(F.when(has(t), F.lit(v)) for t, v in LAYOUTS)).alias("layout"),
        )

    def judged(f: Column) -> Column:
        hits = sum((f[x].isNotNull().cast("int") for x in ("fish", "angle", "layout")), F.lit(0))
        return F.struct(
            F.when(f["fish"].isNotNull(), F.lit("fisheye")).when(f["angle"].isNotNull(), F.lit("equirect")).alias("projection"), f["layout"].alias("layout"),
            F.coalesce(f["fish"], f["angle"]).alias("fov"), F.least(F.lit(1.0), hits / 3.0).alias("confidence"),
        )

    return _let(_let(tokens(name), found), judged)


def detect_format(name: Column, aspect: Column, assume: Column) -> Column:
    """STRUCT projection, layout, fov, confidence, source: the name first, then aspect ratio, then the assumption."""
    both = F.struct(_named(name).alias("own"), _named(F.coalesce(assume, F.lit(""))).alias("other"), aspect.alias("aspect"), (F.coalesce(assume, F.lit("")) != "").alias("assume"))

    def fused(x: Column) -> Column:
        own, other = x["own"], x["other"]
        known = own["projection"].isNotNull() & own["layout"].isNotNull()
        seen = F.when(x["aspect"] >= WIDE, F.lit("sbs")).when((x["aspect"] <= TALL) & (x["aspect"] != 0), F.lit("tb"))
        by_aspect = F.when(own["layout"].isNull(), seen)
        assumed = ~known & x["assume"]
        fill = lambda k: F.coalesce(own[k], F.when(assumed, other[k]))
        layout = F.coalesce(own["layout"], by_aspect, F.when(assumed, other["layout"]))
        parts = F.array_compact(F.array(
            F.when(own["confidence"] > 0, F.lit("filename")), F.when(by_aspect.isNotNull(), F.lit("aspect")), F.when(assumed, F.lit("assumed"))
        ))
        source = F.when(known, F.lit("filename")).when(F.size(parts) == 0, F.lit("none")).otherwise(F.array_join(parts, "+"))
        return F.struct(
            F.coalesce(fill("projection"), F.lit("unknown")).alias("projection"), F.coalesce(layout, F.lit("unknown")).alias("layout"), fill("fov").alias("fov"),
            F.when(assumed, F.lit(0.3)).otherwise(own["confidence"]).alias("confidence"), source.alias("source"),
        )

    return _let(both, fused)


def effective_format(stored: Column, flat: Column, name: Column, aspect: Column, assume: Column) -> Column:
    """detect_format under a stored correction: flat wins, then a token that names a whole format; other tokens fall through."""
    none = F.lit(None).cast("string")
    forced, found = detect_format(F.coalesce(stored, F.lit("")), none.cast("double"), none), detect_format(name, aspect, assume)
    raw = F.struct(
        F.lit("unknown").alias("projection"), F.lit("mono").alias("layout"), none.cast("double").alias("fov"), F.lit(0.0).alias("confidence"),
        F.lit("override:flat").alias("source"),
    )
    known = (forced["projection"] != "unknown") & (forced["layout"] != "unknown")
    return F.when(F.coalesce(flat, F.lit(False)), raw).when(known, forced).otherwise(found)


def short_number(x: Column) -> Column:
    """A number without trailing zeros; null stays null."""
    return F.when(x.isNotNull(), F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"\.?0+$", ""))


def dewarp_filter(
    fmt: Column, viewport: float = 100.0, yaw: float = 0.0, pitch: float = 0.0, size: int = 512, scale: int = 1600, strict: bool = False
) -> Column:
    """Crop of one eye, scaling and flat viewport of a format; null, or with `strict` an error, where it isn't supported."""
    eye = F.when(fmt["layout"] == "sbs", F.lit("crop=iw/2:ih:0:0")).when(fmt["layout"] == "tb", F.lit("crop=iw:ih/2:0:0")).when(
        fmt["layout"] == "mono", F.lit("")
    )
    fov = F.coalesce(fmt["fov"], F.lit(180.0))
    wide = F.concat(F.lit("input=fisheye:ih_fov="), short_number(fov), F.lit(":iv_fov="), short_number(fov))
    spec = F.when((fmt["projection"] == "equirect") & (fov <= 180.0 + 1e-6), F.lit("input=he")).when(fmt["projection"] == "fisheye", wide)
    view = F.concat(
        F.lit("v360="), spec, F.lit(f":output=flat:h_fov={viewport:g}:v_fov={viewport:g}:yaw={yaw:g}:pitch={pitch:g}:w={size}:h={size}")
    )
    scaled = F.lit(f"scale={scale}:{scale}" if scale else "")
    whole = F.array_join(F.filter(F.array(eye, scaled, view), lambda x: x != ""), ",")
    known = F.when(eye.isNotNull() & view.isNotNull(), whole)
    wrong = F.concat_ws(" ", F.lit("no viewport for"), fmt["projection"], fmt["layout"], fov.cast("string"))
    return F.coalesce(known, F.raise_error(wrong)) if strict else known


def log_times(text: Column) -> Column:
    """Presentation times in a decoder's log."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"pts_time:\s*([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))
