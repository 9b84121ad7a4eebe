"""Queries by name, with their SQL oracles."""

from brindle.plans import php_queries, queries as q, report_queries, rule_queries, tree_queries

QUERIES = {
    "score_by_source": q.score_by_source,
    "affected_union": q.affected_union,
    "dup_exact_groups": q.dup_exact_groups,
    "drift_pairs": q.drift_pairs,
    "masked_minority": q.masked_minority,
    "placeholder_docs": q.placeholder_docs,
    "baseline_partition": q.baseline_partition,
    "baseline_used": q.baseline_used,
    "diff_partition": q.diff_partition,
    "blast_radius": q.blast_radius,
    "risk_ranked": q.risk_ranked,
    "risk_by_file": q.risk_by_file,
    "dead_keys": q.dead_keys,
    "missing_target": q.missing_target,
    "layer_edges": q.layer_edges,
    "role_first_match": q.role_first_match,
    "closure_depth": q.closure_depth,
    "asof_last_event": q.asof_last_event,
    "occurrence_ids": q.occurrence_ids,
    "counts_zero_filled": q.counts_zero_filled,
    "hunk_contains": q.hunk_contains,
    "innermost_span": q.innermost_span,
    "vote_signals": q.vote_signals,
    "test_weakened": q.test_weakened,
    "weakened_findings": q.weakened_findings,
    "repeated_guards": q.repeated_guards,
    "line_runs": q.line_runs,
    "growth": q.growth,
    "tiers_by_rule": q.tiers_by_rule,
}

ORACLES = {
    "score_by_source": q.SCORE_SQL,
    "affected_union": q.UNION_SQL,
    "dup_exact_groups": q.DUP_SQL,
    "drift_pairs": q.DRIFT_SQL,
    "masked_minority": q.MASKED_SQL,
    "placeholder_docs": q.PLACEHOLDER_SQL,
    "baseline_partition": q.BASELINE_SQL,
    "baseline_used": q.USED_SQL,
    "diff_partition": q.DIFF_SQL,
    "blast_radius": q.BLAST_SQL,
    "risk_ranked": q.RISK_SQL,
    "risk_by_file": q.RISK_FILE_SQL,
    "dead_keys": q.DEAD_SQL,
    "missing_target": q.MISSING_SQL,
    "layer_edges": q.LAYER_SQL,
    "role_first_match": q.ROLE_SQL,
    "closure_depth": q.CLOSURE_SQL,
    "asof_last_event": q.ASOF_SQL,
    "occurrence_ids": q.OCCURRENCE_SQL,
    "counts_zero_filled": q.COUNTS_SQL,
    "hunk_contains": q.HUNK_SQL,
    "innermost_span": q.INNER_SQL,
    "vote_signals": q.VOTE_SQL,
    "test_weakened": q.WEAKENED_SQL,
    "weakened_findings": q.WEAKENED_FINDINGS_SQL,
    "repeated_guards": q.GUARD_SQL,
    "line_runs": q.RUNS_SQL,
    "growth": q.GROWTH_SQL,
    "tiers_by_rule": q.TIERS_SQL,
}

for more in (report_queries.QUERIES, tree_queries.QUERIES, rule_queries.QUERIES):
    QUERIES |= {name: query for name, (query, _) in more.items()}
    ORACLES |= {name: sql for name, (_, sql) in more.items()}
QUERIES["php_findings"], ORACLES["php_findings"] = php_queries.php_findings, php_queries.PHP_SQL
