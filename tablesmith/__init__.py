"""Tabular data preparation and reporting on Apache Spark."""

from .functions.keywords import load_keyword_map, tag_by_table, tag_keywords
from .functions.names import drop_duplicate_columns, name_similarity, resolve, snake, snake_columns, suggest_mapping
from .operators.align import align_schemas, merge_aligned, schema_compatibility
from .operators.clean import CleanPlan, apply_clean, drop_empty, infer_clean, level1_clean, standardize
from .operators.dedupe import dedupe, dedupe_report
from .operators.impute import fill, handle_missing_values, impute, missing_patterns, suggest_strategies
from .operators.kpi import diff_metrics, kpi_before_after, kpi_metrics, report_kpi
from .operators.match import match_names
from .operators.outlier import detect_outliers, handle_outliers, iqr_clip, outlier, zscore_clip
from .operators.pivot import PivotSpec, filter_in, group_sum, month_bucket, pivot_long, pivot_report, pivot_subtotals, pivot_wide
from .operators.profile import profile, profile_columns, profile_numeric, profile_types
from .operators.sketches import merge_profiles, profile_sketches, stored_profiles
from .operators.timeseries import add_mom, add_running_total, period_summary
from .operators.validate import gate, gated_write, summarize, validate, validate_rows
from .plans.preprocess import preprocess, preprocess_file, run_folder
from .plans.recipe import Recipe, run_recipe, run_steps
from .plans.report import build_report, log_run, write_report
from . import functions, operators, plans, sources, streaming
from .session import build_session, deal, tune
from .sources.csv import detect_encodings, infer_types, read_csv_table, read_null_tokens, write_table

__all__ = [name for name in dir() if not name.startswith("_")]
