"""Duplicate patients: links, person clusters, and what their charts miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import is_blank, split_items, strip
from carelattice.session import cut_lineage


def _fingerprint(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def exact_links(rows: DataFrame, key: list[str], id: str = "id") -> DataFrame:
    """(id, lead_id) for each row whose whole key equals that of an earlier id.

    Every copy is linked to the group's smallest id, one row per copy: no pairs.
    Rows with a blank key part are no copies of anything. Keys are compared by their
    SHA-256, written once, so long texts are read once and never shuffled.
    """
    complete = rows
    for column in key:
        complete = complete.where(~is_blank(F.col(column).cast("string")))
    keyed = cut_lineage(
        complete.select(F.col(id).alias("id"), _fingerprint(key).alias("_key")), "keys"
    )
    leads = (
        keyed.groupBy("_key")
        .agg(F.min("id").alias("lead_id"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .drop("_n")
    )
    return keyed.join(leads, "_key").where(F.col("id") != F.col("lead_id")).select("id", "lead_id")


def swap_safe_dob(dob: Column) -> Column:
    """Year and the two other numbers in rising order: equal for day-month swaps."""
    shape = "^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
    a, b = F.regexp_extract(dob, shape, 2), F.regexp_extract(dob, shape, 3)
    key = F.concat_ws("-", F.regexp_extract(dob, shape, 1), F.least(a, b), F.greatest(a, b))
    return F.when(dob.rlike(shape), key)


def person_keys(patients: DataFrame, coverages: DataFrame | None = None) -> DataFrame:
    """(id, block, name, initial_name): one row per patient and identifier held.

    A block is one ssn, phone, mrn or member id together with the birth date, days and
    months exchangeable. A blank identifier or an unreadable date makes no block.
    """
    held = patients.select(
        "id",
        F.regexp_replace(F.lower(strip(F.col("name"))), "\\s+", " ").alias("name"),
        swap_safe_dob(F.col("dob")).alias("_dob"),
        "ssn", "phone", "mrn",
    )
    own = held.select(
        "id", "name", "_dob",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"))
                    for k in ("ssn", "phone", "mrn")
                ]
            )
        ),
    )
    if coverages is not None:
        members = coverages.select(
            F.col("patient_id").alias("id"),
            F.lit("member_id").alias("kind"),
            F.col("member_id").alias("value"),
        ).where(~is_blank(F.col("value"))).distinct()
        own = own.unionByName(
            held.select("id", "name", "_dob").join(members, "id").select(
                "id", "name", "_dob", "kind", "value"
            )
        )
    usable = own.where(~is_blank(F.col("value")) & F.col("_dob").isNotNull())
    words = F.split("name", " ")
    return usable.select(
        "id",
        F.concat_ws("|", "kind", strip(F.col("value")), "_dob").alias("block"),
        "name",
        F.concat_ws("|", F.substring("name", 1, 1), F.element_at(words, -1)).alias("initial_name"),
    )


def _spread(values: DataFrame) -> DataFrame:
    """The values evenly over as many tasks as a shuffle has: each becomes many patterns."""
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return values.repartition(n)


def _deletion_hashes(value: Column, max_distance: int) -> Column:
    """Hashes of all texts left after deleting up to `max_distance` characters.

    Two texts within edit distance k share at least one of them.
    """
    def shorter(state: Column) -> Column:
        text, start = state["text"], state["start"]
        one_less = F.transform(
            F.sequence(start, F.length(text)),
            lambda i: F.struct(
                F.concat(
                    F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))
                ).alias("text"),
                i.alias("start"),
            ),
        )
        none = F.array().cast("array<struct<text:string,start:int>>")
        return F.when(start <= F.length(text), one_less).otherwise(none)

    # Deleting from left to right reaches every set of places once.
    newest = F.array(F.struct(value.alias("text"), F.lit(1).alias("start")))
    reached = [newest]
    for _ in range(max_distance):
        newest = F.flatten(F.transform(newest, shorter))
        reached.append(newest)
    texts = F.concat(*reached)
    return F.array_distinct(F.transform(texts, lambda s: F.xxhash64(s["text"])))


# Names that may share a segment, or a block, before their group is searched another way, see `near_values`
# and `near_links`.
GROUP_NAMES = 256


def _segment_keys(value: Column, max_distance: int) -> Column:
    """(key, own): hashes of the segments a text is indexed by, and of the parts it looks up.

    A text is cut into k + 1 segments of even length. Of two texts within k edits, the longer (or
    equally long) one holds a segment of the other one unchanged, moved by as many places as the
    edits before it allow and those after it leave over. These are at most (k + 1)^3 parts whatever the
    length of the text. The idea is that of Pass-Join (Li et al., VLDB 2011).
    """
    parts = max_distance + 1
    length = F.length(value)
    found = []
    for shorter in range(parts):
        other = length - shorter
        size, longer = F.floor(other / parts).cast("int"), other % parts
        for i in range(1, parts + 1):
            # The last segments take a remainder of the length, one character each.
            before = F.greatest(F.lit(0), longer - (parts + 1 - i))
            start = 1 + (i - 1) * size + before
            held = size + F.when(longer >= parts + 1 - i, 1).otherwise(0)
            low = max(1 - i, shorter - (parts - i))
            high = min(i - 1, shorter + (parts - i))
            for moved in range(low, high + 1):
                at = start + moved
                inside = (other >= 0) & (at >= 1) & (at + held - 1 <= length)
                key = F.xxhash64(F.lit(i), other, F.substring(value, at, held))
                own = F.lit(shorter == 0 and moved == 0)
                found.append(F.when(inside, F.struct(key.alias("_key"), own.alias("_own"))))
    return F.array_distinct(F.array_compact(F.array(*found)))


def _near_candidates(
    values: DataFrame, block: list[str], value: str, max_distance: int
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of `values` in pairs that share a segment, the second row's columns named `_other_...`;
    and, if there are any, the rows of groups in which too many share one.

    Every pair within `max_distance` edits is among the former or has both rows among the latter. A row
    meets at most GROUP_NAMES others for each of its segments.
    """
    columns = values.columns
    segments = cut_lineage(
        _spread(values).select("*", F.inline(_segment_keys(F.col(value), max_distance))), "segments"
    )
    group = [*block, "_key"]
    crowded = cut_lineage(
        segments.where("_own").groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > GROUP_NAMES).drop("_n"),
        "crowded-segments",
    )
    rest, members = segments, None
    if not crowded.isEmpty():
        rest = segments.join(crowded, group, "left_anti")
        members = segments.join(crowded, group, "left_semi").select(*columns).distinct()
    owners = rest.where("_own").select(
        *group, *[F.col(c).alias(f"_other_{c}") for c in columns if c not in block]
    )
    # The segments' files are far smaller than their rows: joins of such tables are never broadcast.
    return rest.drop("_own").hint("merge").join(owners, group), members


def near_values(
    rows: DataFrame, block: list[str], value: str, max_distance: int
) -> DataFrame:
    """Distinct values of a block within `max_distance` edits of each other.

    Distinct values meet on (block, segment), see `_segment_keys`: a few rows for each value, however
    long, so copies and unlike values of a large block never meet; the edit distance then decides.
    Values of a segment that too many share meet on a hash of the text with up to `max_distance` characters
    left out instead. Exact for any block size.
    """
    distinct = rows.where(F.col(value).isNotNull()).select(*block, value).distinct()
    pairs, crowded = _near_candidates(distinct, block, value, max_distance)
    pairs = pairs.select(*block, value, F.col(f"_other_{value}").alias("_other"))
    if crowded is not None:
        hashed = _spread(_trimmed(crowded, block, value)).select(
            *block, value, F.explode(_deletion_hashes(F.col("_trimmed"), max_distance)).alias("_hash")
        )
        met = hashed.hint("merge").join(hashed.withColumnRenamed(value, "_other"), [*block, "_hash"])
        pairs = pairs.unionByName(met.select(*block, value, "_other"))
    low, high = F.least(value, "_other"), F.greatest(value, "_other")
    distance = F.levenshtein(value, "_other", max_distance)
    return (
        pairs.where((F.col(value) != F.col("_other")) & (distance >= 0))
        .select(*block, low.alias("value_a"), high.alias("value_b"), distance.alias("distance"))
        .distinct()
    )


def _common_start(low: Column, high: Column) -> Column:
    """How many characters the two texts begin with in common."""
    shorter = F.least(F.length(low), F.length(high))
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    unlike = F.filter(
        places, lambda i: F.substring(low, i, F.lit(1)) != F.substring(high, i, F.lit(1))
    )
    return F.coalesce(F.array_min(unlike) - 1, shorter)


def _trimmed(values: DataFrame, block: list[str], value: str) -> DataFrame:
    """The rows with `_trimmed`, the value without what all values of its block begin and end with, and
    `_shortest`, the least length of those. Edit distances within a block stay as they are.

    What all begin with is what the least and the greatest value begin with.
    """
    backwards = F.reverse(value)
    shapes = values.groupBy(*block).agg(
        F.min(value).alias("_a"), F.max(value).alias("_b"), F.min(backwards).alias("_c"),
        F.max(backwards).alias("_d"), F.min(F.length(value)).alias("_short"),
    )
    start = _common_start(F.col("_a"), F.col("_b"))
    end = F.least(_common_start(F.col("_c"), F.col("_d")), F.col("_short") - F.col("_start"))
    shapes = shapes.withColumn("_start", start).withColumn("_end", end).select(
        *block, "_start", "_end", (F.col("_short") - F.col("_start") - F.col("_end")).alias("_shortest")
    )
    inner = F.substring(value, F.col("_start") + 1, F.length(value) - F.col("_start") - F.col("_end"))
    return values.join(shapes, block).withColumn("_trimmed", inner).drop("_start", "_end")


_WILD = "\uffff"


def _edit_patterns(value: Column, max_distance: int, longer: Column) -> Column:
    """The (pattern, wild, deleted) reached by up to `max_distance` edits, an edit being a
    character replaced by a wildcard or left out.

    Two texts are within k edits of each other exactly when they share a pattern with
    wild + deleted in one + deleted in the other <= k. Texts of one length share one from which both
    left out as much, so wild + 2 * deleted <= k does for a text that is not `longer` than others.
    """
    def edited(state: Column) -> Column:
        text, start = state["text"], state["start"]
        spent = state["wild"] + 2 * state["deleted"]

        def at(i: Column) -> Column:
            before, after = F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))
            replaced = F.struct(
                F.concat(before, F.lit(_WILD), after).alias("text"), (i + 1).alias("start"),
                (state["wild"] + 1).alias("wild"), state["deleted"].alias("deleted"),
            )
            left_out = F.struct(
                F.concat(before, after).alias("text"), i.alias("start"),
                state["wild"].alias("wild"), (state["deleted"] + 1).alias("deleted"),
            )
            return F.when(longer | (spent + 2 <= max_distance), F.array(replaced, left_out)).otherwise(
                F.array(replaced)
            )

        none = F.array().cast("array<struct<text:string,start:int,wild:int,deleted:int>>")
        reached = F.flatten(F.transform(F.sequence(start, F.length(text)), at))
        more = (start <= F.length(text)) & (longer | (spent < max_distance))
        return F.when(more, reached).otherwise(none)

    zero = F.lit(0)
    newest = F.array(
        F.struct(value.alias("text"), F.lit(1).alias("start"), zero.alias("wild"), zero.alias("deleted"))
    )
    reached = [newest]
    for _ in range(max_distance):
        newest = F.flatten(F.transform(newest, edited))
        reached.append(newest)
    # A pattern reached in two ways (one of two equal letters left out) stays twice: a
    # distinct over structs would cost more than the row.
    return F.transform(
        F.concat(*reached),
        lambda s: F.struct(
            s["text"].alias("_pattern"), s["wild"].alias("_wild"), s["deleted"].alias("_deleted")
        ),
    )


def near_links(values: DataFrame, value: str, max_distance: int) -> DataFrame:
    """(id, lead_id) that connect all values (`block`, `value`, `id`) of a block which
    chains of at most `max_distance` edits connect. Each link is itself that near.

    In blocks of up to GROUP_NAMES values they meet on (block, segment), see `_segment_keys`, and every near
    pair is a link. In larger blocks `_pattern_links` gives fewer links that connect the same values; their
    rows are not unfolded to segments.
    """
    kept = values.select("block", F.col(value).alias("_value"), "id")
    large = cut_lineage(
        kept.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_NAMES).drop("_n"),
        "large-blocks",
    )
    crowded = not large.isEmpty()
    small = kept.join(large, "block", "left_anti") if crowded else kept
    segments = cut_lineage(
        _spread(small).select("*", F.inline(_segment_keys(F.col("_value"), max_distance))), "segments"
    )
    group = ["block", "_key"]
    owners = segments.where("_own").select(
        *group, F.col("_value").alias("_other_value"), F.col("id").alias("_other_id")
    )
    # The segments' files are far smaller than their rows: joins of such tables are never broadcast.
    links = segments.drop("_own").hint("merge").join(owners, group).where(
        (F.col("id") != F.col("_other_id"))
        & (F.levenshtein("_value", "_other_value", max_distance) >= 0)
    ).select(
        F.greatest("id", "_other_id").alias("id"), F.least("id", "_other_id").alias("lead_id")
    )
    if crowded:
        links = links.unionByName(
            _pattern_links(kept.join(large, "block", "left_semi"), "_value", max_distance)
        )
    return links.distinct()


def _pattern_links(values: DataFrame, value: str, max_distance: int) -> DataFrame:
    """Links as `near_links` describes them, for blocks of any size.

    Values that share an edit pattern are all linked to the one least deleted from: any
    two of them that are near enough are also near enough to that one. So every pattern
    gives one link per value, never the pairs of its group.

    Values are trimmed of what a whole block has in common, so numbered names are as short as their numbers.
    Values of one length meet on patterns from which both left out as much; patterns with more left out
    are made where the block holds shorter values. They are kept as 64-bit hashes and written once, with the
    trimmed value, on which the edit distance confirms each link.
    """
    short = _spread(_trimmed(values.select("block", "id", value), ["block"], value))
    longer = F.length("_trimmed") > F.col("_shortest")
    patterns = cut_lineage(
        short.select(
            "block", "id", "_trimmed", F.inline(_edit_patterns(F.col("_trimmed"), max_distance, longer))
        ).select("block", "id", "_trimmed", F.xxhash64("_pattern").alias("_pattern"), "_wild", "_deleted"),
        "edit-patterns",
    )
    group = ["_pattern", "_wild", "block"]
    leads = (
        patterns.groupBy(*group)
        .agg(F.min(F.struct("_deleted", "id", "_trimmed")).alias("_lead"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
    )
    lead = F.col("_lead.id")
    edits = F.col("_wild") + F.col("_deleted") + F.col("_lead._deleted")
    return (
        patterns.hint("merge").join(leads, group)
        .where((edits <= max_distance) & (F.col("id") != lead))
        .where(F.levenshtein("_trimmed", F.col("_lead._trimmed"), max_distance) >= 0)
        .select(F.greatest("id", lead).alias("id"), F.least("id", lead).alias("lead_id"))
        .distinct()
    )


def _near_pairs(keys: DataFrame, max_distance: int) -> DataFrame:
    """(id, lead_id) of every two patients of a block whose names are near or equal."""
    names = keys.select("block", "name", "id")
    near = near_values(names, ["block"], "name", max_distance).drop("distance")
    ids = near.hint("merge").join(
        names.select("block", F.col("name").alias("value_a"), F.col("id").alias("_a")), ["block", "value_a"]
    ).hint("merge").join(
        names.select("block", F.col("name").alias("value_b"), F.col("id").alias("_b")), ["block", "value_b"]
    ).select("_a", "_b")
    equal = names.withColumnRenamed("id", "_a").hint("merge").join(names.withColumnRenamed("id", "_b"), ["block", "name"])
    return ids.unionByName(equal.where("_a < _b").select("_a", "_b")).select(
        F.greatest("_a", "_b").alias("id"), F.least("_a", "_b").alias("lead_id")
    )


def match_links(
    patients: DataFrame, coverages: DataFrame | None = None, max_distance: int = 2,
    every_pair: bool = False,
) -> DataFrame:
    """(id, lead_id, rule): patients that are likely one person.

    They share a block (see `person_keys`) and have the same name, the same initial
    and surname, or names within `max_distance` edits. Equal values are linked to
    their smallest id and near ones by `near_links`: no rule forms the pairs of a block. With `every_pair`
    the rule `near_name` holds every two patients of a block whose names are that near or equal, which are
    as many rows as there are such pairs; to find persons, the fewer links do.
    """
    keys = cut_lineage(person_keys(patients, coverages), "person-keys")
    names = cut_lineage(
        keys.groupBy("block", "name").agg(
            F.min("id").alias("lead_id"), F.min("initial_name").alias("initial_name")
        ),
        "person-names",
    )
    same_name = keys.hint("merge").join(names.drop("initial_name"), ["block", "name"]).select(
        "id", "lead_id", F.lit("same_name").alias("rule")
    )
    initials = names.groupBy("block", "initial_name").agg(F.min("lead_id").alias("_first"))
    same_initial = names.hint("merge").join(initials, ["block", "initial_name"]).select(
        F.col("lead_id").alias("id"), F.col("_first").alias("lead_id"),
        F.lit("initial_and_surname").alias("rule"),
    )
    if every_pair:
        near = _near_pairs(keys, max_distance)
    else:
        near = near_links(names.withColumn("id", F.col("lead_id")), "name", max_distance)
    near_name = near.withColumn("rule", F.lit("near_name"))
    links = same_name.unionByName(same_initial).unionByName(near_name)
    return links.where(F.col("id") != F.col("lead_id")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("_m"))
    return both.where(F.col("v") > F.col("u")).join(smallest, "u").select(
        F.col("v").alias("u"), F.least("_m", "u").alias("v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("_m"))
    moved = edges.join(smallest, "u").where(F.col("v") != F.col("_m"))
    return (
        moved.select(F.col("v").alias("u"), F.col("_m").alias("v"))
        .unionByName(smallest.select("u", F.col("_m").alias("v")))
        .distinct()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every linked id: alternating large-star and small-star rounds
    (Kiveris et al., SoCC 2014). Each round is two aggregations with map-side minimum
    and two joins; its result is written to the shared folder, so lineage stays short.
    """
    edges = cut_lineage(
        links.select(F.greatest("id", "lead_id").alias("u"), F.least("id", "lead_id").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)), "stars")
        row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def person_clusters(patients: DataFrame, links: DataFrame) -> DataFrame:
    """(patient_id, person_id) for all patients; a person is named by its smallest id."""
    components = connected_components(links)
    return patients.select("id").join(components, "id", "left").select(
        F.col("id").alias("patient_id"), F.coalesce("component", "id").alias("person_id")
    )


def chart_items(encounters: DataFrame, column: str = "allergies") -> DataFrame:
    """Distinct (patient_id, item) from comma-separated text; `none known` is no item."""
    return encounters.select(
        "patient_id", F.explode(split_items(F.col(column))).alias("item")
    ).distinct()


def person_items(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per person and item: on how many of the person's charts it stands."""
    return (
        items.join(clusters, "patient_id")
        .groupBy("person_id", "item")
        .agg(F.count(F.lit(1)).alias("n_charts"))
    )


def reconcile_items(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per chart: items on it, items on any chart of the person, and how many it misses.

    Counts decide the flag; no chart is compared with another.
    """
    own = items.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_own"))
    whole = person_items(items, clusters).groupBy("person_id").agg(
        F.count(F.lit(1)).alias("_whole")
    )
    none = F.lit(0).cast("long")
    return (
        clusters.join(own, "patient_id", "left")
        .join(whole, "person_id", "left")
        .select(
            "patient_id",
            "person_id",
            F.coalesce("_own", none).alias("n_own"),
            F.coalesce("_whole", none).alias("n_person"),
        )
        .withColumn("n_missing", F.col("n_person") - F.col("n_own"))
        .withColumn("incomplete", F.col("n_missing") > 0)
    )


def missing_items(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """(patient_id, person_id, item) for each item another chart of the person has.

    Only charts already known to miss something are unfolded.
    """
    gaps = reconcile_items(items, clusters).where("incomplete").select("patient_id", "person_id")
    union = person_items(items, clusters).select("person_id", "item")
    return gaps.join(union, "person_id").join(items, ["patient_id", "item"], "left_anti")


def goldset_audit(
    cases: DataFrame, records: DataFrame, encounters: DataFrame, clusters: DataFrame
) -> DataFrame:
    """Per gold-set case: does it cite the expected patient, and what does that chart
    miss of the person's records and allergies."""
    cited = cases.select(
        "case_id", "expected_patient_id", F.explode_outer("cites_records").alias("id")
    )
    checked = (
        cited.join(records.select("id", F.col("patient_id").alias("_cited")), "id", "left")
        .groupBy("case_id")
        .agg(
            F.count("id").alias("n_cited"),
            F.count_if(F.col("id").isNotNull() & F.col("_cited").isNull()).alias("n_unknown"),
            F.count_if(F.col("_cited") != F.col("expected_patient_id")).alias("n_other_patient"),
        )
    )
    per_chart = records.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_chart_records"))
    per_person = (
        per_chart.join(clusters, "patient_id")
        .groupBy("person_id")
        .agg(F.sum("n_chart_records").alias("n_person_records"))
    )
    allergies = reconcile_items(chart_items(encounters), clusters).select(
        "patient_id", "person_id", F.col("n_missing").alias("n_missing_allergies")
    )
    expected = cases.drop("cites_records").withColumn("patient_id", F.col("expected_patient_id"))
    none = F.lit(0).cast("long")
    return (
        expected.join(checked, "case_id")
        .join(allergies, "patient_id", "left")
        .join(per_chart, "patient_id", "left")
        .join(per_person, "person_id", "left")
        .drop("patient_id")
        .withColumn("n_chart_records", F.coalesce("n_chart_records", none))
        .withColumn("n_person_records", F.coalesce("n_person_records", none))
        .withColumn("n_missing_allergies", F.coalesce("n_missing_allergies", none))
        .withColumn(
            "misleading",
            (F.col("n_other_patient") > 0)
            | (F.col("n_unknown") > 0)
            | (F.col("n_missing_allergies") > 0)
            | (F.col("n_person_records") > F.col("n_chart_records")),
        )
    )
