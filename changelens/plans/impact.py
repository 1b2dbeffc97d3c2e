"""From changed files and source files to callers, evidence and headlines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from changelens.operators import impact as op
from changelens.operators import symbols as sym
from changelens.operators.grouping import materialize
from changelens.options import DEFAULTS, Options


@dataclass(frozen=True)
class Impact:
    symbols: DataFrame
    names: DataFrame
    scanned: DataFrame
    callers: DataFrame
    symbol_impact: DataFrame
    shown: DataFrame
    sections: DataFrame
    evidence: DataFrame
    headlines: DataFrame
    stats: DataFrame


def changed_symbols(changed_files: DataFrame, source_files: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    per_file = materialize(sym.file_symbols(changed_files, source_files))
    found = sym.touched_symbols(per_file).unionByName(sym.removed_symbols(per_file, options.max_removed_per_file))
    return sym.top_symbols(found, options.max_symbols_per_file)


def impact(
    changed_files: DataFrame, source_files: DataFrame, options: Options = DEFAULTS, all_changed: DataFrame | None = None
) -> Impact:
    """``changed_files`` are the reviewed files; ``all_changed`` also holds the skipped ones (default: the same)."""
    symbols = materialize(changed_symbols(changed_files, source_files, options))
    names = sym.searched_names(symbols, options.max_names)
    scanned = materialize(sym.scan(source_files, names, options.max_scan_files, options.max_parse_files))
    definers = sym.definers(scanned)
    grouped = op.drop_redundant_imports(op.group_callers(op.uses(symbols, sym.hits(scanned))))
    flagged = op.in_changed_file(grouped, changed_files if all_changed is None else all_changed)
    callers = materialize(op.with_flags(op.link_tier(flagged, scanned, definers)))
    counted = op.symbol_counts(symbols, callers, definers)
    shown = op.with_snippets(materialize(op.top_callers(callers, options.max_callers, options.max_callers_body)), source_files)
    sections = op.evidence(op.keep_symbols(counted), shown, options.evidence_chars, options.secret_rules)
    return Impact(
        symbols, names, scanned, callers, counted, shown, sections, op.evidence_by_file(sections, scanned),
        op.headlines(sections, options.max_headlines), op.impact_stats(symbols, names, scanned),
    )
