"""Model families, their search ranges and the stored parameter sets.

Names before ``__`` say which part a value belongs to: ``classifier`` or
``resampler``. A setting is one dict of such names, and ``resampler`` itself
names the kind of rebalancing.
"""

from __future__ import annotations

FAMILIES = ("logistic", "random_forest", "gradient_boosting", "xgboost")

# Resampling options tried with every family.
RESAMPLER_GRID = (
    {"resampler": ["none"]},
    {"resampler": ["smote"], "resampler__k_neighbors": [3, 5]},
    {"resampler": ["undersample"], "resampler__sampling_strategy": [0.5]},
    {"resampler": ["oversample"], "resampler__sampling_strategy": [0.7, 1.0]},
)

# Wider resampling options of the exploratory searches.
WIDE_RESAMPLER_GRID = {
    "random_forest": (
        {"resampler": ["none"], "classifier__class_weight": [None, "balanced", "balanced_subsample"]},
        {"resampler": ["smote"], "resampler__k_neighbors": [3, 5, 7]},
        {"resampler": ["undersample"], "resampler__sampling_strategy": [0.3, 0.5, 0.7]},
        {"resampler": ["oversample"], "resampler__sampling_strategy": [0.5, 0.7, 1.0]},
        {"resampler": ["adasyn"], "resampler__n_neighbors": [3, 5, 7]},
        {"resampler": ["smoten"], "resampler__k_neighbors": [3, 5, 7]},
        {"resampler": ["cluster_centroids"], "resampler__sampling_strategy": [0.5, 0.7, 1.0]},
    ),
    "gradient_boosting": (
        {"resampler": ["none"]},
        {"resampler": ["smote"], "resampler__k_neighbors": [3, 5, 7]},
        {"resampler": ["undersample"], "resampler__sampling_strategy": [0.3, 0.5, 0.7]},
        {"resampler": ["oversample"], "resampler__sampling_strategy": [0.5, 0.7, 1.0]},
    ),
    "xgboost": (
        {"resampler": ["none"]},
        {"resampler": ["smote"], "resampler__k_neighbors": [3, 5, 10]},
        {"resampler": ["oversample"], "resampler__sampling_strategy": [0.5, 0.7, 1.0]},
        {"resampler": ["undersample"], "resampler__sampling_strategy": [0.2, 0.35, 0.5]},
    ),
}

# Classifier ranges of the exploratory searches.
WIDE_CLASSIFIER_GRID = {
    "random_forest": {
        "classifier__n_estimators": [100, 200, 300, 400],
        "classifier__max_depth": [5, 10, 15, 20, None],
        "classifier__max_features": ["sqrt", "log2", 0.3],
        "classifier__min_samples_split": [2, 5, 10],
        "classifier__min_samples_leaf": [1, 3, 5],
        "classifier__bootstrap": [True, False],
    },
    "gradient_boosting": {
        "classifier__n_estimators": [100, 200, 300],
        "classifier__learning_rate": [0.01, 0.05, 0.1, 0.2],
        "classifier__max_depth": [3, 4, 5, 6],
        "classifier__min_samples_split": [2, 5, 10],
        "classifier__min_samples_leaf": [1, 3, 5],
        "classifier__subsample": [0.7, 0.8, 0.9, 1.0],
    },
    "xgboost": {
        "classifier__n_estimators": [100, 200, 300, 400, 500],
        "classifier__learning_rate": [0.01, 0.05, 0.1, 0.2],
        "classifier__max_depth": [3, 5, 7, 9],
        "classifier__subsample": [0.7, 0.8, 0.9, 1.0],
        "classifier__colsample_bytree": [0.7, 0.8, 0.9, 1.0],
        "classifier__gamma": [0, 0.1, 0.5, 1, 2],
        "classifier__reg_alpha": [0, 0.01, 0.1, 1],
        "classifier__reg_lambda": [0.1, 1, 5, 10],
    },
}

# Classifier ranges per family.
CLASSIFIER_GRID = {
    "logistic": {
        "classifier__C": [0.01, 0.1, 1, 10, 100],
        "classifier__penalty": ["l1", "l2"],
        "classifier__solver": ["liblinear"],
    },
    "random_forest": {
        "classifier__n_estimators": [100, 200, 300],
        "classifier__max_depth": [5, 10, 15, None],
        "classifier__min_samples_split": [2, 5, 10],
        "classifier__min_samples_leaf": [1, 3, 5],
    },
    "gradient_boosting": {
        "classifier__n_estimators": [100, 200],
        "classifier__learning_rate": [0.05, 0.1, 0.2],
        "classifier__max_depth": [3, 4, 5],
    },
    "xgboost": {
        "classifier__n_estimators": [100, 200, 300],
        "classifier__learning_rate": [0.01, 0.05, 0.1],
        "classifier__max_depth": [3, 5, 7],
        "classifier__subsample": [0.8, 0.9, 1.0],
        "classifier__colsample_bytree": [0.8, 0.9, 1.0],
    },
}

# Bounded search ranges as (kind, low, high).
BOUNDED = {
    "random_forest": {
        "resampler": ("choice", ["oversample"]),
        "resampler__sampling_strategy": ("uniform", 0.8, 1.0),
        "classifier__n_estimators": ("integer", 180, 220),
        "classifier__max_depth": ("integer", 8, 12),
        "classifier__max_features": ("choice", ["log2"]),
        "classifier__min_samples_split": ("integer", 8, 12),
        "classifier__min_samples_leaf": ("integer", 4, 6),
    },
    "gradient_boosting": {
        "resampler": ("choice", ["smote"]),
        "resampler__k_neighbors": ("integer", 2, 5),
        "classifier__n_estimators": ("integer", 250, 350),
        "classifier__learning_rate": ("log", 0.005, 0.02),
        "classifier__max_depth": ("integer", 2, 5),
        "classifier__min_samples_split": ("integer", 3, 7),
        "classifier__min_samples_leaf": ("integer", 2, 5),
        "classifier__subsample": ("uniform", 0.7, 0.9),
    },
    "xgboost": {
        "resampler": ("choice", ["oversample"]),
        "resampler__sampling_strategy": ("uniform", 0.8, 1.0),
        "classifier__n_estimators": ("integer", 450, 550),
        "classifier__learning_rate": ("log", 0.005, 0.02),
        "classifier__max_depth": ("integer", 2, 4),
        "classifier__gamma": ("uniform", 0.05, 0.2),
        "classifier__subsample": ("uniform", 0.6, 0.8),
        "classifier__colsample_bytree": ("uniform", 0.6, 0.8),
        "classifier__reg_alpha": ("uniform", 0.005, 0.02),
        "classifier__reg_lambda": ("uniform", 0.05, 0.2),
        "classifier__scale_pos_weight": ("uniform", 0.8, 1.2),
    },
}

# The stored best parameters.
STORED = {
    "random_forest": {
        "classifier__bootstrap": True,
        "classifier__class_weight": None,
        "classifier__max_depth": 8,
        "classifier__max_features": "log2",
        "classifier__min_samples_leaf": 4,
        "classifier__min_samples_split": 12,
        "classifier__n_estimators": 212,
        "resampler__sampling_strategy": 0.9258112243519689,
    },
    "xgboost": {
        "classifier__colsample_bytree": 0.6,
        "classifier__gamma": 0.05,
        "classifier__learning_rate": 0.008464520496759586,
        "classifier__max_depth": 4,
        "classifier__n_estimators": 550,
        "classifier__reg_alpha": 0.02,
        "classifier__reg_lambda": 0.05,
        "classifier__scale_pos_weight": 0.8,
        "classifier__subsample": 0.6,
        "resampler__sampling_strategy": 0.8,
    },
    "gradient_boosting": {
        "classifier__learning_rate": 0.02,
        "classifier__max_depth": 3,
        "classifier__min_samples_leaf": 2,
        "classifier__min_samples_split": 3,
        "classifier__n_estimators": 290,
        "classifier__subsample": 0.7,
        "resampler__k_neighbors": 5,
    },
    "logistic": {
        "classifier__C": 0.001,
        "classifier__penalty": "l2",
        "classifier__solver": "liblinear",
    },
}


def family_grid(family: str) -> list[dict]:
    """Grids to sample from: one per resampling option."""
    if family not in CLASSIFIER_GRID:
        raise ValueError(f"unknown model family: {family}")
    return [{**CLASSIFIER_GRID[family], **option} for option in RESAMPLER_GRID]


def exploratory_grid(family: str, positive_weight: float = 1.0) -> list[dict]:
    """Wider grids to sample from, of the families that were explored.

    Without resampling, boosted trees also try ``positive_weight``, which is
    meant to be the number of negatives per positive.
    """
    if family not in WIDE_CLASSIFIER_GRID:
        raise ValueError(f"no exploratory ranges for: {family}")
    grids = []
    for option in WIDE_RESAMPLER_GRID[family]:
        grid = {**WIDE_CLASSIFIER_GRID[family], **option}
        if family == "xgboost":
            plain = option["resampler"] == ["none"]
            grid["classifier__scale_pos_weight"] = [1, positive_weight] if plain else [1]
        grids.append(grid)
    return grids
