"""Column expressions that turn wire fields into span fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.numbers import add, subtract
from spanloom.schema import PROTOCOL_TAG, PROTOCOL_TEXT, TIMINGS

FEW_TAGS = 64  # that are looked up one after the other


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def timings_from_annotations(annotations: Column) -> dict[str, Column]:
    """Annotations are struct<at_ns, value, service>; the last one of a kind wins."""
    return {
        key: F.coalesce(
            F.try_element_at(
                F.filter(annotations, lambda a: (a["value"] == key) & (a["at_ns"] != 0)),
                F.lit(-1),
            )["at_ns"],
            _zero(),
        )
        for key in TIMINGS
    }


def timings_from_kind(kind: Column, start: Column, duration: Column) -> dict[str, Column]:
    end = add(start, duration)
    # In any case; lower() looks each text up in Unicode's tables.
    client, server = kind.rlike(r"^(?i:client)\z"), kind.rlike(r"^(?i:server)\z")
    return {
        "cs": F.when(client, start).otherwise(_zero()),
        "cr": F.when(client, end).otherwise(_zero()),
        "ss": F.when(server, end).otherwise(_zero()),
        "sr": F.when(server, start).otherwise(_zero()),
    }


def fill_start_duration(
    start: Column, duration: Column, cs: Column, cr: Column, ss: Column, sr: Column
) -> tuple[Column, Column]:
    """The client pair beats the server pair, which beats the span's own fields."""
    client, server = (cs > 0) & (cr > 0), (sr > 0) & (ss > 0)
    return (
        F.when(client, cs).when(server, sr).otherwise(start),
        F.when(client, subtract(cr, cs)).when(server, subtract(ss, sr)).otherwise(duration),
    )


def default_duration(duration: Column) -> Column:
    return F.when(duration == 0, F.lit(1_000_000).cast("bigint")).otherwise(duration)


def resolve_service(*candidates: Column) -> Column:
    """First non-empty name of the given arrays of names."""
    names = F.filter(F.concat(*candidates), lambda s: s != "")
    return F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_entries(entries: Column) -> Column:
    """Of array<struct<key,value>> the last entry of each key. In a short list keys are looked for one after the
    other, a long one is sorted by key."""

    def dedup(numbered: Column) -> Column:
        def is_last(e: Column, i: Column) -> Column:
            following = F.get(numbered, i + 1)
            return following.isNull() | (following["key"] != e["key"])

        return F.transform(
            F.filter(numbered, is_last),
            lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
        )

    def settled(entries: Column) -> Column:
        by_key = F.sort_array(
            F.transform(
                entries,
                lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value")),
            )
        )
        short = F.filter(
            entries, lambda e, i: ~F.array_contains(F.slice(entries["key"], i + 2, F.size(entries)), e["key"])
        )
        return F.when(F.size(entries) <= FEW_TAGS, short).otherwise(_let(by_key, dedup))

    return _let(entries, settled)


def last_wins_map(entries: Column) -> Column:
    """array<struct<key,value>> to a map; of equal keys the last one stays.

    Does not rely on spark.sql.mapKeyDedupPolicy.
    """
    return F.map_from_entries(last_entries(entries))


def build_tags(entries: Column, protocol: str) -> Column:
    """Tag entries to a map, then the protocol tag, which no user tag can replace."""
    own = F.filter(last_entries(entries), lambda e: e["key"] != PROTOCOL_TAG)
    marker = F.struct(
        F.lit(PROTOCOL_TAG).alias("key"), F.lit(PROTOCOL_TEXT[protocol]).alias("value")
    )
    return F.map_from_entries(F.concat(own, F.array(marker)))


def jaeger_tags(tags: Column) -> tuple[Column, Column]:
    """Tags are struct<key, value>, value null unless it is a text: (span kind, tags to keep)."""

    def key(t: Column) -> Column:
        return F.coalesce(t["key"], F.lit(""))

    kinds = F.filter(tags, lambda t: (key(t) == "span.kind") & t["value"].isNotNull())
    kind = F.coalesce(F.try_element_at(kinds, F.lit(-1))["value"], F.lit(""))
    kept = F.transform(
        F.filter(tags, lambda t: t["value"].isNotNull() & ~key(t).isin("internal.span.format", "span.kind")),
        lambda t: F.struct(
            F.when(t["key"] == "component", "lc").otherwise(key(t)).alias("key"),
            t["value"].alias("value"),
        ),
    )
    return kind, kept


def jaeger_parent(references: Column, span_id: Column, read: Callable[[Column], Column] = lambda c: c) -> Column:
    """References are struct<ref_type, span_id>; the last CHILD_OF one names the parent. Only its id is `read`."""
    parents = F.filter(references, lambda r: r["ref_type"] == "CHILD_OF")
    parent = F.try_element_at(parents, F.lit(-1))
    return F.when(parent.isNotNull(), read(parent["span_id"])).otherwise(span_id)
