"""Budgets of one run. Every limit is a named option; operators take the value they need as a keyword."""

from __future__ import annotations

from dataclasses import dataclass

from changelens import rules


@dataclass(frozen=True)
class Options:
    # --- fixed values: default budgets ---
    max_pages: int | None = None
    page_size: int = 100
    max_files: int = 30
    max_total_chars: int = 160_000
    max_file_chars: int = 24_000
    max_chunk_chars: int = 12_000
    max_commits_per_push: int = 5
    max_symbols_per_file: int | None = None
    max_removed_per_file: int | None = None
    max_names: int | None = None
    max_callers: int = 4
    max_callers_body: int = 2
    max_scan_files: int | None = None
    max_parse_files: int | None = None
    evidence_chars: int = 7_000
    max_headlines: int = 8
    max_findings_per_chunk: int | None = 8
    max_findings_per_file: int | None = 12
    max_secrets_per_file: int | None = None
    max_inline: int = 50
    verify_max_findings: int = 10
    max_excerpt_chars: int = 4_000
    max_impact_chars: int = 3_000
    max_reason_chars: int = 300
    summary_findings: int = 40
    max_summary_chars: int = 1_500
    max_comment_chars: int = 60_000
    max_message_chars: int = 2_000
    max_body_bytes: int = 5 * 1024 * 1024
    max_contents_bytes: int | None = None
    snapshot_max_files: int | None = None
    snapshot_max_file_bytes: int | None = None
    snapshot_max_total_bytes: int | None = None
    keep_cache: int = 1_500
    recall_items: int = 12
    recall_max_tokens: int = 1_500
    feedback_ttl_minutes: int = 30
    review_events: tuple[str, ...] = ("push",)
    allowed_repos: tuple[str, ...] = ()
    trusted_logins: tuple[str, ...] = ()
    secret_rules: tuple[tuple[str, str], ...] = rules.SECRET_RULES
    conventions: tuple[str, ...] = rules.CONVENTION_PATHS
    model: str = "reviewer"
    prompt_version: str = "1"
    language: str = "English"


DEFAULTS = Options()
