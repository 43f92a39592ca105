"""Matching compositions to candidate entries and choosing the best entry.

Two ways to the best entry are offered. The plain way joins every composition
to every candidate and reduces; it is what one wants when the candidates
themselves are the result. The pipeline way reduces the entries *first*, to
one winner per chemical system (and per formula in it), and joins winners: a
system holding a third of all entries and of all compositions then costs one
pre-aggregated row, not their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xtalframe.functions.element_sets import contains, element_set, index_symbols, set_key, tidy
from xtalframe.functions.formula import chemical_system, match_key, parse_formula
from xtalframe.functions.once import compute_once
from xtalframe.functions.structure_text import cell_to_text, sites_to_text, validate_structure
from xtalframe.functions.text import null_to_inf
from xtalframe.operators.clean import filter_deprecated
from xtalframe.operators.skew import PAIRS, SHARE, left_join
from xtalframe.schemas import ELEMENT_SET_ENTRY
from xtalframe.session import stored


def dedup_first(df: DataFrame, key: str, row_id: str, *values: str) -> DataFrame:
    """First row per key in order of ``row_id``; null keys are dropped.

    Numeric values keep fixed-width buffers, so this stays a hash aggregate
    with a map-side partial; a hot key shrinks before the shuffle.
    """
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.min_by(v, row_id).alias(v) for v in values], F.min(row_id).alias(row_id))
    )


def first_k_per_key(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key. Catalyst limits each group before the
    shuffle as well as after it, so a hot key sends at most k rows per task."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_rank")


def add_formula_keys(df: DataFrame, formula: str, match: bool = True) -> DataFrame:
    """Add ``chemsys`` and, with ``match``, the reduced-formula ``formula_key``."""
    keys = {"chemsys": chemical_system(F.col(formula))}
    if match:
        keys["formula_key"] = match_key(parse_formula(F.col(formula)))
    return compute_once(df, keys)


def join_candidates_chemsys(
    compositions: DataFrame, entries: DataFrame, require_formula_match: bool = False, share: int = SHARE
) -> DataFrame:
    """Every composition with the not-deprecated entries of its chemical system.

    Both sides carry ``chemsys`` and ``formula_key``. A composition without
    candidates keeps one row of nulls. ``formula_match`` tells whether the
    candidate reduces to the same formula. A system that more than ``share``
    entries or compositions have is spread over tasks.
    """
    right = filter_deprecated(entries).withColumn("entry_formula_key", F.col("formula_key"))
    keys = ["chemsys", "formula_key"] if require_formula_match else ["chemsys"]
    right = right if require_formula_match else right.drop("formula_key")
    same = F.coalesce(F.col("formula_key") == F.col("entry_formula_key"), F.lit(False))
    return left_join(compositions, right, keys, share=share).withColumn("formula_match", same)


def _winner(entries: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Least rank per key: a few numbers a row, whatever the entry holds."""
    return entries.groupBy(*keys).agg(F.min(rank).alias("rank"))


def best_entry_mp(
    compositions: DataFrame,
    entries: DataFrame,
    key: str = "composition",
    row_id: str = "row_id",
    require_formula_match: bool = False,
) -> DataFrame:
    """Best candidate per composition, one row each; none gives a null ``entry``.

    Lowest energy above hull, then lowest formation energy (missing counts as
    infinite), then a candidate of the same reduced formula, then input order.

    Ranks (two energies and the unique ``row_id``) are reduced to one winner per
    (system, formula) and from those to one per system, both with map-side
    partials; the winner of a composition is its system's unless its own
    formula's winner ties with that one. Only then are the winners' entries
    fetched by their ``row_id``.
    """
    columns = [c for c in entries.columns if c not in ("chemsys", "formula_key")]
    usable = filter_deprecated(entries)
    rank = F.struct(
        null_to_inf(F.col("energy_above_hull")).alias("hull"),
        null_to_inf(F.col("formation_energy_per_atom")).alias("energy"),
        F.col(row_id).alias("row"),
    )
    by_formula = _winner(usable, ["chemsys", "formula_key"], rank)
    ranked = compositions.join(by_formula.withColumnRenamed("rank", "_same"), ["chemsys", "formula_key"], "left")
    if require_formula_match:
        chosen = F.col("_same.row")
    else:
        by_system = _winner(by_formula, ["chemsys"], F.col("rank")).withColumnRenamed("rank", "_best")
        ranked = ranked.join(by_system, "chemsys", "left")
        same, best = F.col("_same"), F.col("_best")
        ties = (same["hull"] == best["hull"]) & (same["energy"] == best["energy"])
        chosen = F.when(same.isNotNull() & ties, same["row"]).otherwise(best["row"])
    # without a candidate there is no row to meet; a key of its own keeps such
    # compositions from all going to the task of the null key
    alone = F.concat(F.lit("no:"), F.col(key))
    named = ranked.withColumn("_row", F.coalesce(F.concat(F.lit("row:"), chosen.cast("string")), alone))
    named = named.drop("_same", "_best", "chemsys", "formula_key")
    at = F.concat(F.lit("row:"), F.col(row_id).cast("string"))
    fetched = usable.select(at.alias("_row"), F.struct(*columns).alias("entry"))
    return named.join(fetched, "_row", "left").drop("_row")


def union_ids(candidates: DataFrame, material_id: str = "material_id") -> DataFrame:
    """Distinct candidate ids; null and empty ones are skipped."""
    wanted = F.nullif(F.col(material_id), F.lit(""))
    return candidates.select(wanted.alias(material_id)).where(wanted.isNotNull()).distinct()


def candidate_ids(compositions: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct ids of entries that are a candidate of some composition.

    Same result as ``union_ids(join_candidates_chemsys(...))``, by a semi join
    on the distinct systems asked for: no candidate pair is ever built.
    """
    asked = compositions.select("chemsys").distinct()
    return union_ids(filter_deprecated(entries).join(asked, "chemsys", "left_semi"))


def join_details(
    candidates: DataFrame, details: DataFrame, material_id: str = "material_id"
) -> tuple[DataFrame, DataFrame]:
    """(candidates with their details, candidates whose id has no details)."""
    hits = candidates.join(details, material_id, "inner")
    misses = candidates.join(details.select(material_id), material_id, "left_anti")
    return hits, misses


def join_structure_dos(best: DataFrame, structures: DataFrame, dos: DataFrame) -> DataFrame:
    """Attach structure text and density of states by ``material_id``; null when absent."""
    return best.join(structures, "material_id", "left").join(dos, "material_id", "left")


def join_tc(
    docs: DataFrame, tc: DataFrame, composition: str = "composition", row_id: str = "row_id"
) -> DataFrame:
    """Attach the critical temperature of the first row of each composition."""
    first = dedup_first(tc, composition, row_id, "critical_temperature_tc").drop(row_id)
    return docs.join(first, composition, "left")


# --- candidates by element set -------------------------------------------------


def _distinct_sets(df: DataFrame) -> DataFrame:
    """key, elements (sorted, distinct) and bits of every set that is not empty,
    stored: there are far fewer than records, and they are read several times."""
    sets = df.select(tidy(F.col("elements")).alias("elements")).where(F.size("elements") > 0).distinct()
    return stored(sets.select(set_key(F.col("elements")).alias("key"), "elements", element_set(F.col("elements")).alias("bits")), "element-sets")


def containing_sets(wanted: DataFrame, available: DataFrame, mode: str = "contains", share: int = SHARE) -> DataFrame:
    """Pairs of element sets ``(wanted_set, available_set)`` that match, by their
    keys.

    Both inputs have one column ``elements`` and are reduced to distinct sets
    first: the join works on sets, whose number is far below the number of
    records. ``contains``: available holds all wanted elements; ``subset``:
    wanted holds all available elements; ``exact``: equal.

    For the two inclusions the larger sets are indexed by every two of their
    elements (and by each single one), the smaller set asks with its two rarest
    only: a common element such as oxygen is a key for hardly any set, and
    hardly any pair that meets is no inclusion. Inclusion is a test of bits.
    """
    small, large = (available, wanted) if mode == "subset" else (wanted, available)
    small, large = _distinct_sets(small), _distinct_sets(large)
    if mode == "exact":
        pairs = small.join(large.select("key"), "key").select(F.col("key").alias("small_set"), F.col("key").alias("large_set"))
    else:
        small, large = (d.withColumn("names", index_symbols(F.col("elements"))) for d in (small, large))
        # at most 119 names, whatever the data
        counted = large.select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        table = counted.select(F.map_from_entries(F.collect_list(F.struct("name", "n")))).scalar()
        rank = lambda names: F.array_sort(
            F.transform(names, lambda e: F.struct(F.coalesce(F.try_element_at(F.col("rarity"), e), F.lit(0).cast("bigint")).alias("n"), e.alias("name")))
        )
        ranked = lambda df: df.withColumn("rarity", table).withColumn("ranked", rank(F.col("names"))).drop("rarity")
        second = F.coalesce(F.try_element_at("ranked", F.lit(2)), F.element_at("ranked", 1))["name"]
        asking = ranked(small).select(F.col("ranked")[0]["name"].alias("rare"), second.alias("next"), F.col("key").alias("small_set"), F.col("bits").alias("small"))
        first = ranked(large).select("key", "bits", "ranked", F.posexplode("ranked").alias("at", "r"))
        rest = F.slice("ranked", F.col("at") + 1, F.size("ranked"))  # the element itself, then those after it
        index = first.select(F.col("r.name").alias("rare"), F.explode(rest).alias("s"), F.col("key").alias("large_set"), F.col("bits").alias("large"))
        index = index.select("rare", F.col("s.name").alias("next"), "large_set", "large")
        met = left_join(asking, index, ["rare", "next"], "inner", share)
        pairs = met.where(contains(F.col("large"), F.col("small"))).select("small_set", "large_set")
    names = ("available_set", "wanted_set") if mode == "subset" else ("wanted_set", "available_set")
    return pairs.toDF(*names)


def join_candidates_elements(
    compositions: DataFrame,
    entries: DataFrame,
    mode: str = "contains",
    per_key: int | None = None,
    key: str = "composition",
    entry_id: str = "entry_id",
    share: int = SHARE,
    most: int = PAIRS,
) -> DataFrame:
    """Every composition with the entries matching its element set.

    Both sides carry ``elements``. A composition without a match keeps one row
    of nulls. ``per_key`` keeps the first so many by ``entry_id``, for callers
    that want the page limit of a remote service; by default all are kept. A
    set that more than ``share`` records have, or that makes more than ``most``
    rows, is spread over tasks.
    """
    pairs = stored(containing_sets(compositions, entries, mode, share), "set-pairs")
    right = entries.withColumn("available_set", set_key(F.col("elements"))).drop("elements")
    asked = compositions.withColumn("wanted_set", set_key(F.col("elements")))
    by_set = left_join(asked, pairs, ["wanted_set"], share=share, pairs=most)
    found = left_join(by_set, right, ["available_set"], share=share, pairs=most).drop("wanted_set", "available_set")
    if per_key is None:
        return found
    return first_k_per_key(found, [key], [F.col(entry_id).asc_nulls_last()], per_key)


def best_by_element_set(
    compositions: DataFrame, entries: DataFrame, order: list[Column], mode: str = "contains"
) -> DataFrame:
    """Best matching entry per composition without building candidate pairs.

    Entries are stored under a number and reduced to the least rank per element
    set, ranks to one per wanted set, and only the winners' entries are fetched
    and joined to the compositions. ``order`` must be a total order over the
    entry columns; of equal entries any one is taken.
    """
    columns = [c for c in entries.columns if c != "elements"]
    rows = stored(entries.withColumn("_at", F.monotonically_increasing_id()), "entries")
    rank = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.col("_at").alias("at"))
    least = lambda df, by: df.groupBy(by).agg(F.min("rank").alias("rank"))
    ranks = rows.select(set_key(F.col("elements")).alias("available_set"), rank.alias("rank"))
    per_set = least(ranks.where(F.col("available_set").isNotNull()), "available_set")
    pairs = containing_sets(compositions, rows, mode)
    per_wanted = stored(least(pairs.join(per_set, "available_set"), "wanted_set"), "winners")
    fetched = rows.select(F.col("_at"), F.struct(*columns).alias("entry"))
    winners = per_wanted.select("wanted_set", F.col("rank.at").alias("_at")).join(fetched, "_at").drop("_at")
    asked = compositions.withColumn("wanted_set", set_key(F.col("elements")))
    return asked.join(winners, "wanted_set", "left").drop("wanted_set")  # one winner a set


def best_entry_oqmd(entries: DataFrame, key: str = "supercon_composition", address: list[str] | None = None) -> DataFrame:
    """Best structurally valid entry per composition as a processed row.

    ``entries`` has one row per (composition, ``entry`` struct); a composition
    whose list was null or empty comes as one row with a null entry. Lowest
    ``delta_e``, then ``stability`` (missing counts as infinite), then
    ``entry_id`` (missing counts as 0). Compositions without a valid entry
    keep a row of nulls: an invalid entry sorts after every valid one instead
    of being filtered out, so no second pass has to bring the keys back.

    Only ranks and addresses are aggregated; the winners' entries are fetched by
    their address afterwards. ``address`` names the columns that tell every row
    apart, such as the file and the row in it that a reader gives; without it
    the rows are stored under numbers first.
    """
    if address is None:
        entries = stored(entries.withColumn("_at", F.monotonically_increasing_id()), "entries")
        address = ["_at"]
    entry = F.col("entry")
    valid = validate_structure(entry["unit_cell"], entry["sites"])
    rank = F.struct(
        (~valid).alias("invalid"),
        null_to_inf(entry["delta_e"]).alias("delta_e"),
        null_to_inf(entry["stability"]).alias("stability"),
        F.coalesce(entry["entry_id"], F.lit(0).cast("bigint")).alias("entry_id"),
        *[F.col(c).alias(f"at{k}") for k, c in enumerate(address)],
    )
    # computed before the aggregate sorts its input: no entry is sorted
    ranks = compute_once(entries, {"_rank": rank}).select(key, "_rank")
    best = ranks.groupBy(key).agg(F.min("_rank").alias("best"))
    name = lambda parts: F.concat_ws("|", F.lit("row"), *[p.cast("string") for p in parts])
    # a composition without a valid entry gets a name that no row has
    won = F.when(F.col("best.invalid"), F.concat(F.lit("none|"), F.coalesce(F.col(key), F.lit("")))).otherwise(
        name([F.col(f"best.at{k}") for k in range(len(address))])
    )
    fetched = entries.select(name([F.col(c) for c in address]).alias("_won"), "entry")
    best = best.select(key, won.alias("_won")).join(fetched, "_won", "left")
    return best.select(
        F.col(key),
        entry["entry_id"].alias("oqmd_entry_id"),
        entry["name"].alias("oqmd_formula"),
        entry["spacegroup"].alias("oqmd_spacegroup"),
        entry["delta_e"].alias("oqmd_delta_e"),
        entry["stability"].alias("oqmd_stability"),
        entry["band_gap"].alias("oqmd_band_gap"),
        entry["prototype"].alias("oqmd_prototype"),
        cell_to_text(entry["unit_cell"]).alias("oqmd_unit_cell_json"),
        sites_to_text(entry["sites"]).alias("oqmd_sites_json"),
        entry["icsd_id"].alias("oqmd_icsd_id"),
    )


def explode_entry_map(docs: DataFrame, key: str = "supercon_composition") -> DataFrame:
    """Keyed lists of entries (``entries`` array) to one row per entry; a null
    or empty list keeps its key with a null entry."""
    return docs.select(F.col(key), F.explode_outer("entries").alias("entry"))


ENTRY_SCHEMA = ELEMENT_SET_ENTRY
