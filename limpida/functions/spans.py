"""Spans of matches, and folds over them, as native expressions.

Offsets count code points from zero; the end is exclusive. The builders here take and
give SQL text: a fold of some hundred nodes is then parsed in one step, while building
it call by call from Python would cost more time than running it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items whose results are collected in one list, see ``fold``.
BLOCK = 256
MATCH_TYPE = "array<struct<span_start:int,span_end:int,value:string>>"


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """Mark a costly column so that no filter is pushed below its projection.

    A filter on a derived column is normally rewritten in terms of the columns beneath,
    which runs every expression on the way a second time, and through a chain of
    projections twice per link. A non-deterministic marker, always true, prevents that.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def bind(name: str, value: str, body: str) -> str:
    """``let`` in SQL text: ``body`` refers to ``value`` by ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def matches(text: Column, java_pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern), F.lit(0))


def gaps(text: Column, java_pattern: str) -> Column:
    """The text between the matches; always one element more than the matches."""
    return F.split(text, java_pattern, -1)


def fold(tag: str, items: str, out_type: str, state: str, step: str, finish: str) -> str:
    """Left fold that collects a list, in time linear in the number of items.

    Appending copies the list, so one list would cost the square of its length. Blocks of
    ``BLOCK`` items collect their own lists, which are joined at the end.

    ``step`` is SQL text over ``{tag}_acc`` (fields ``out`` and ``state``) and ``{tag}_h``, the
    item; ``finish`` is over ``{tag}_all`` (fields ``parts``, a list of lists, and ``state``).
    """
    block = f"""transform(
        sequence({tag}_no * {BLOCK}, least(({tag}_no + 1) * {BLOCK}, size({tag}_items)) - 1),
        {tag}_j -> get({tag}_items, {tag}_j))"""
    body = f"""aggregate(
        sequence(0, (size({tag}_items) - 1) div {BLOCK}),
        named_struct('parts', CAST(array() AS array<array<{out_type}>>), 'state', {state}),
        ({tag}_all, {tag}_no) -> aggregate(
            {block},
            named_struct('out', CAST(array() AS array<{out_type}>), 'state', {tag}_all.state),
            ({tag}_acc, {tag}_h) -> {step},
            {tag}_end -> named_struct(
                'parts', array_append({tag}_all.parts, {tag}_end.out), 'state', {tag}_end.state)),
        {tag}_all -> {finish})"""
    return bind(f"{tag}_items", items, f"CASE WHEN size({tag}_items) > 0 THEN {body} END")


def locate(found: str, between: str) -> str:
    """Give every match its span: gaps and matches alternate, so lengths add up."""
    return fold(
        "loc",
        f"zip_with({found}, {between}, (loc_m, loc_g) -> struct(loc_m AS value, length(loc_g) AS gap))",
        "struct<span_start:int,span_end:int,value:string>",
        "0",
        """named_struct(
            'out', CASE WHEN loc_h.value IS NULL THEN loc_acc.out ELSE array_append(loc_acc.out,
                named_struct(
                    'span_start', loc_acc.state + loc_h.gap,
                    'span_end', loc_acc.state + loc_h.gap + length(loc_h.value),
                    'value', loc_h.value)) END,
            'state', loc_acc.state + loc_h.gap + coalesce(length(loc_h.value), 0))""",
        "flatten(loc_all.parts)",
    )


def match_spans(text: str, java_pattern: str) -> str:
    """All non-overlapping matches with exact spans. The pattern must not match ''.

    A text without a match is scanned once, one with matches a second time for the gaps.
    """
    pattern = quote(java_pattern)
    spans = locate("fnd", f"split({text}, {pattern}, -1)")
    none = f"CAST(array() AS {MATCH_TYPE})"
    return bind(
        "fnd",
        f"regexp_extract_all({text}, {pattern}, 0)",
        f"CASE WHEN size(fnd) = 0 THEN {none} ELSE {spans} END",
    )


def without_overlap(hits: str, allowed: str, hit_type: str) -> str:
    """Hits that touch none of the allowed spans, in order of their ends.

    One sweep from left to right, linear in both but for a sort: allowed spans are met at their start,
    hits at their end, so a hit is touched if an allowed span met before it ends behind its start.
    """
    events = f"""array_sort(concat(
        transform({allowed}, evt_a -> named_struct(
            'at', evt_a.span_start, 'kind', 1, 'span_end', evt_a.span_end, 'hit', CAST(NULL AS {hit_type}))),
        transform({hits}, evt_h -> named_struct('at', evt_h.span_end, 'kind', 0, 'span_end', 0, 'hit', evt_h))))"""
    swept = fold(
        "swp",
        events,
        hit_type,
        "0",
        """CASE
            WHEN swp_h.kind = 1 THEN named_struct(
                'out', swp_acc.out, 'state', greatest(swp_acc.state, swp_h.span_end))
            WHEN swp_acc.state <= swp_h.hit.span_start THEN named_struct(
                'out', array_append(swp_acc.out, swp_h.hit), 'state', swp_acc.state)
            ELSE swp_acc END""",
        "flatten(swp_all.parts)",
    )
    return f"CASE WHEN size({allowed}) = 0 THEN {hits} ELSE {swept} END"


def merge_overlaps(hits: str, hit_type: str) -> str:
    """One pass from left to right against the current hit.

    A regex hit beats a name hit; between two of one method the longer wins and a tie
    keeps the first. This is no union of intervals: a hit that lost has no say in what
    comes next, so a window over gaps would give other results.
    """
    apart = "(mrg_acc.state.span_end <= mrg_h.span_start OR mrg_h.span_end <= mrg_acc.state.span_start)"
    longer = (
        "mrg_h.span_end - mrg_h.span_start > mrg_acc.state.span_end - mrg_acc.state.span_start"
    )
    wins = f"""CASE WHEN mrg_h.method = mrg_acc.state.method THEN {longer}
        ELSE mrg_h.method = 'regex' END"""
    merged = fold(
        "mrg",
        f"array_sort({hits})",
        hit_type,
        f"CAST(NULL AS {hit_type})",
        f"""CASE
            WHEN mrg_acc.state IS NULL THEN named_struct('out', mrg_acc.out, 'state', mrg_h)
            WHEN {apart} THEN
                named_struct('out', array_append(mrg_acc.out, mrg_acc.state), 'state', mrg_h)
            ELSE named_struct(
                'out', mrg_acc.out, 'state', CASE WHEN {wins} THEN mrg_h ELSE mrg_acc.state END)
            END""",
        "array_append(flatten(mrg_all.parts), mrg_all.state)",
    )
    return f"CASE WHEN size({hits}) < 2 THEN {hits} ELSE {merged} END"


def wide(text: str) -> str:
    """Text in a coding with four bytes a character: cutting the text itself would walk from
    its start for every piece."""
    return f"encode({text}, 'UTF-32')"


def piece(wide_text: str, start: str, length: str | None = None) -> str:
    """Cut from ``wide`` text, to its end without ``length``. The mark put in front keeps the
    piece's own first character from being read as one."""
    size = "" if length is None else f", 4 * ({length})"
    return f"decode(concat(X'0000FEFF', substring({wide_text}, 4 * ({start}) + 1{size})), 'UTF-32')"


def replace_spans(text: str, hits: str, marker: str) -> str:
    """Put a marker in place of every span; hits are sorted and disjoint.

    ``marker`` is SQL text over ``rep_h``, the hit.
    """
    end = "coalesce(get(rep_hits, rep_i - 1).span_end, 0)"
    pieces = f"""flatten(transform(rep_hits, (rep_h, rep_i) -> array(
        {piece("rep_wide", end, f"rep_h.span_start - {end}")}, {marker})))"""
    last = piece("rep_wide", "element_at(rep_hits, -1).span_end")
    joined = bind("rep_hits", hits, f"array_join(array_append({pieces}, {last}), '')")
    replaced = bind("rep_wide", wide(text), joined)
    return f"CASE WHEN size({hits}) > 0 THEN {replaced} ELSE {text} END"
