"""R3/R4/R6/R11 from wear counts that are kept up by signed deltas.

The reports count the records behind every item and every outfit.  Recomputing
that reads all of RECORD and INCLUDES; a change touches a few rows of them.  So the
counts are a stored state, and every change set says which records and links it
inserted (+1) and deleted (-1).  With R the records, L the links and new = old +
delta, the wears of an item change by

    delta L x new R  +  old L x delta R

(rows of delta L, and links of outfits in delta R, alone are read).  Counts are
sums and simply added.  A latest date is a maximum: an inserted later one takes its
place at once, and only for keys whose latest date was deleted it is looked up
again, in those keys' own records.  Keys whose count falls to 0 leave the state,
so a state is always what a recomputation would give.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearhouse.operators.changes import ChangeResult
from wearhouse.plans.factorised import item_wears, outfit_wears
from wearhouse.plans.session import materialize
from wearhouse.sources.tables import Tables


@dataclass(frozen=True)
class WearState:
    """items (item_id, wear_count, last_recorded) and outfits (outfit_id,
    worn_count, last_worn) with at least one record."""

    items: DataFrame
    outfits: DataFrame


@dataclass(frozen=True)
class WearDelta:
    """What a change set did: records (outfit_id, datetime, sign) and links
    (outfit_id, item_id, sign), sign +1 for an inserted and -1 for a deleted row."""

    records: DataFrame
    links: DataFrame


def wear_state(t: Tables) -> WearState:
    """The state of whole tables."""
    return WearState(item_wears(t), outfit_wears(t))


def stored_wear_state(t: Tables) -> WearState:
    """The state of whole tables, written: the items' part is made from the outfits'."""
    outfits = materialize(outfit_wears(t))
    return WearState(materialize(item_wears(t, outfits)), outfits)


def _signed(df: DataFrame, sign: int, *cols: str) -> DataFrame:
    return df.select(*cols, F.lit(sign).cast("bigint").alias("sign"))


_REC, _LINK = ("outfit_id", "datetime"), ("outfit_id", "item_id")


def inserted(result: ChangeResult) -> WearDelta:
    """The delta of a job that only adds rows (M8, M11): its appended rows."""
    t = result.tables
    rows = {n: result.appends.get(n, t.get(n).limit(0)) for n in ("w_rec", "w_inc")}
    return WearDelta(_signed(rows["w_rec"], 1, *_REC), _signed(rows["w_inc"], 1, *_LINK))


def records_deleted(old: Tables, result: ChangeResult) -> WearDelta:
    """The delta of M12's deletes: the applied keys."""
    gone = result.applied.select(*_REC).distinct()
    return WearDelta(_signed(gone, -1, *_REC), _signed(old.w_inc.limit(0), -1, *_LINK))


def outfits_deleted(old: Tables, result: ChangeResult) -> WearDelta:
    """The delta of M10: the records and links of the applied outfits."""
    keys = result.applied.select("outfit_id").distinct()
    return WearDelta(
        _signed(old.w_rec.join(keys, "outfit_id", "left_semi"), -1, *_REC), _signed(old.w_inc.join(keys, "outfit_id", "left_semi"), -1, *_LINK)
    )


def difference(old: Tables, new: Tables) -> WearDelta:
    """The delta between two sets of tables, for any other job (M4, M7, M9, M16):
    it reads both whole, which the others spare."""

    def both(name: str, cols: tuple[str, ...]) -> DataFrame:
        signed = _signed(new.get(name), 1, *cols).unionByName(_signed(old.get(name), -1, *cols))
        return signed.groupBy(*cols).agg(F.sum("sign").alias("sign")).where("sign <> 0")

    return WearDelta(both("w_rec", _REC), both("w_inc", _LINK))


def _per_outfit(records: DataFrame) -> DataFrame:
    """(outfit_id, _n, _came, _went) of signed records: their sum and the latest that came and went."""
    came, went = F.when(F.col("sign") > 0, F.col("datetime")), F.when(F.col("sign") < 0, F.col("datetime"))
    return records.groupBy("outfit_id").agg(F.sum("sign").alias("_n"), F.max(came).alias("_came"), F.max(went).alias("_went"))


def _per_key(wears: DataFrame, key: str) -> DataFrame:
    """(key, _n, _came, _went) summed up again, to one row for each key."""
    return wears.groupBy(key).agg(F.sum("_n").alias("_n"), F.max("_came").alias("_came"), F.max("_went").alias("_went"))


def _wears(old: Tables, delta: WearDelta, changed: DataFrame | None = None) -> DataFrame:
    """(item_id, _n, _came, _went): the wears that came and went, one row for each
    link: records are reduced to their outfit before they are spread to its items
    (``changed``, where that is stored already)."""
    if changed is None:
        changed = _per_outfit(delta.records)
    of_records = old.w_inc.join(changed, "outfit_id").select("item_id", "_n", "_came", "_went")
    # Written, so that few outfits are broadcast and the records are not moved to meet them.
    linked = materialize(delta.links.select("outfit_id").distinct())
    near = _per_outfit(_signed(old.w_rec.join(linked, "outfit_id", "left_semi"), 1, *_REC))
    now = _per_key(near.unionByName(changed.join(linked, "outfit_id", "left_semi").select(*near.columns)), "outfit_id")
    there = F.col("sign") > 0  # with a link that went, what its outfit had is gone
    of_links = delta.links.join(now, "outfit_id").select(
        "item_id", (F.col("sign") * F.col("_n")).alias("_n"),
        F.when(there, F.col("_came")).otherwise(F.col("_went")).alias("_came"), F.when(there, F.col("_went")).otherwise(F.col("_came")).alias("_went"),
    )
    return of_records.unionByName(of_links)


#: So many keys whose latest date went are looked up on their own.
FEW_KEYS = 100_000


def _merged(state: DataFrame, key: str, count: str, latest: str, change: DataFrame, again) -> DataFrame:
    """``state`` plus ``change`` (key, _n, _came, _went; one row for each key).
    ``again`` gives (key, latest) of the tables as they are now, for a frame of few
    keys or (without one) for all."""
    known = F.greatest(latest, "_came")  # NULLs are passed over
    rows = state.join(change, key, "full_outer").select(
        key,
        (F.coalesce(count, F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("bigint").alias(count),
        known.alias(latest),
        F.coalesce(F.col("_went") >= known, F.lit(False)).alias("_lost"),
    )
    rows = materialize(rows.where(F.col(count) > 0))
    lost = rows.where("_lost")
    few = lost.count() <= FEW_KEYS
    rebuilt = lost.select(key, count).join(again(F.broadcast(lost.select(key)) if few else None), key).select(key, count, latest)
    return rows.where("NOT _lost").select(key, count, latest).unionByName(rebuilt)


def apply_delta(state: WearState, old: Tables, new: Tables, delta: WearDelta) -> WearState:
    """The state after a change set that turned ``old`` into ``new``.

    Reads of ``old`` only the links and records of the changed outfits, of ``new``
    only those of the keys whose latest date was deleted.  Where these are many, all
    of ``new`` is read, as finding the keys' own rows would move all of them twice:
    its records are reduced to their outfit once for both halves of the state, and if
    the outfits needed none of that, their half of the state says what the items ask.
    """
    reduced: list[DataFrame] = []

    def latest_of_outfits(keys: DataFrame | None) -> DataFrame:
        if keys is None:
            reduced.append(materialize(outfit_wears(new)))
        wears = reduced[0] if reduced else outfit_wears(new.with_tables(w_rec=new.w_rec.join(keys, "outfit_id", "left_semi")))
        return wears.select("outfit_id", "last_worn")

    def latest_of_items(keys: DataFrame | None) -> DataFrame:
        if keys is None:
            return item_wears(new, reduced[0] if reduced else outfits).select("item_id", "last_recorded")
        links = new.w_inc.join(keys, "item_id", "left_semi")
        records = new.w_rec.join(materialize(links.select("outfit_id").distinct()), "outfit_id", "left_semi")
        return item_wears(new.with_tables(w_inc=links, w_rec=records)).select("item_id", "last_recorded")

    changed = materialize(_per_outfit(delta.records))
    delta = WearDelta(delta.records, materialize(delta.links))
    outfits = _merged(state.outfits, "outfit_id", "worn_count", "last_worn", changed, latest_of_outfits)
    wears = _per_key(_wears(old, delta, changed), "item_id")
    return WearState(_merged(state.items, "item_id", "wear_count", "last_recorded", wears, latest_of_items), outfits)


# ------------------------------------------------------- the reports on a state
def usage_base(t: Tables, state: WearState) -> DataFrame:
    """Every item with its wear count, as ``reports.item_usage(base=...)`` takes it."""
    from wearhouse.plans.factorised import items_with_owner

    items = items_with_owner(t).select("item_id", "u_id", "item_name", "last_worn")
    count: Column = F.coalesce(F.col("wear_count"), F.lit(0)).cast("bigint")
    return items.join(state.items.select("item_id", "wear_count"), "item_id", "left").withColumn("wear_count", count)


def item_usage(t: Tables, state: WearState, direction: str = "DESC", k: int = 5) -> DataFrame:
    """R3 / R4 from the state: neither RECORD nor INCLUDES is read."""
    from wearhouse.operators import reports

    return reports.item_usage(t, direction, k=k, base=usage_base(t, state))


def item_usage_all(t: Tables, state: WearState) -> DataFrame:
    """R11 from the state."""
    return t.w_item.select("item_id", "item_name").join(state.items, "item_id", "left").select(
        "item_id", "item_name", F.coalesce(F.col("wear_count"), F.lit(0)).cast("bigint").alias("wear_count"), "last_recorded"
    )


def outfit_reuse(t: Tables, state: WearState, k: int = 5) -> DataFrame:
    """R6 from the state."""
    from wearhouse.operators import reports

    return reports.outfit_reuse(t, k=k, wears=state.outfits)
