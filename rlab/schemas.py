"""The tables of the library as explicit schemas (DDL)."""

from __future__ import annotations


def fields(ddl: str) -> list[tuple[str, str]]:
    """Names and types of a schema."""
    return [tuple(column.split(" ", 1)) for column in ddl.replace("`", "").split(", ")]


REPORTS = (
    "repo_name string, bug_id string, bug_report_text string, ground_truth_files array<string>, creation_date timestamp, fix_date timestamp, "
    "pre_fix_commit_sha string, fix_commit_sha string, language string, source_dataset string, bug_report_url string, fix_url string"
)
PROJECTS = (
    "repo_name string, language string, LoC long, age_years double, median_bug_year double, num_authors int, num_commits int, num_dependencies int, "
    "polyglot_index double, bug_density double, code_complexity double, bug_report_verbosity double, total_unique_bug_reports int, domain string, "
    "project_size string, project_age string"
)
SNAPSHOTS = ("commit_sha string, path string, blob_sha string")
BLOBS = ("blob_sha string, content string, size long")
COMMITS = ("repo string, commit_sha string, parent_sha string, author_email string, committed_at timestamp")
VECTORS = ("id string, vec array<float>")
CHUNK_VECTORS = ("blob_sha string, chunk_no int, vec array<float>")
SAMPLES = ("bug_id string, blob_sha string, label int, project_type string, retrieval_score double")
RANK_FEATURES = ("bug_id string, blob_sha string, used_in_fix double, f1 double, f2 double, f3 double, f4 double")
RANKINGS = ("bug_id string, gt_blob_sha string, faiss_rank int, model_rank int, rank_displacement int, faiss_score double, model_score double")
RECALL = ("repo_name string, k int, hits long, valid long, recall double")
RESULTS = ("model_name string, source_project string, target_project string, scenario string, `top-1` double, `top-5` double, `top-10` double, MAP double, MRR double")
REPS = ("model_name string, target_project string, scenario string, rep int, `top-1` double, `top-5` double, `top-10` double, MAP double, MRR double, n_target_train int, n_target_test int, wall_time_sec double")
DOMAIN_GAP = ("project_A string, project_B string, lang_A string, lang_B string, num_bugs_A int, num_bugs_B int, domain_gap_accuracy double")
PAIR_SIMILARITY = ("project_A string, project_B string, n_A int, n_B int, mean double, std double, median double")
AST_NODES = ("blob_sha string, node int, token string, type string")
AST_EDGES = ("blob_sha string, source int, target int")
DIR_TREE = ("commit_sha string, path string, parent string, depth int, is_leaf boolean")
