"""Point-cloud defect analytics as Spark DataFrames."""

from voidscope.operators.alignment import align, box_size, box_sizes, center, centroid, frames, pca, project
from voidscope.operators.bandwidth import knn_distance, ms_bandwidth, sample_points
from voidscope.operators.catalog import CATEGORIES, FAMILIES, FEATURES, catalog_statistics, feature_catalog
from voidscope.operators.dataset import (
    dataset_stats,
    feature_dataset,
    fit_preprocessing,
    impute,
    missing_count,
    split,
    standard_scale,
    training_frame,
    vacancy_target,
)
from voidscope.operators.evaluation import (
    feature_category,
    importance_by_category,
    importance_topn,
    method_comparison,
    overfit_flag,
    qq_line,
    qq_points,
    regression_metrics,
    residual_histogram,
    residuals,
)
from voidscope.operators.grid import grid_cells, grid_features
from voidscope.operators.neighbors import nearest_site, radius_pairs
from voidscope.operators.shape import moi_principal, radial_stats, spatial_entropy
from voidscope.operators.surface import keep_selected, surface_atoms, within_surface
from voidscope.operators.wigner_seitz import WignerSeitz, affine_map, pbc_wrap, strain
from voidscope.plans.features import snapshot_features
from voidscope.plans.model import (
    Forest,
    fit_forest,
    importance,
    load_model,
    model_info,
    oof_r2,
    out_of_fold,
    save_model,
    score,
    train,
)
from voidscope.plans.workflows import compare_methods, extract_dataset, geometric_vacancies, predict_vacancies
from voidscope.sources.datasets import read_features_csv, read_points, write_features, write_points
from voidscope.sources.dumps import DumpScan, failed_files, run_summary, scan_dumps

__version__ = "0.1.0"
__all__ = [name for name in dir() if not name.startswith("_")]
