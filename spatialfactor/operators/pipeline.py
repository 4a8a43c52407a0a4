"""The whole way from a raw matrix to a fit: quality control and normalisation, graph, fit, normalised signatures."""

from __future__ import annotations

import logging
import time
from dataclasses import fields
from inspect import signature

from pyspark.sql import DataFrame

from ..config import FitConfig
from .analysis import normalize_q_scale_w
from .fit import FitResult, fit
from .graph import build_graph, laplacian, per_sample_laplacian
from .preprocess import standard_preprocess

LOG = logging.getLogger("spatialfactor")
#: Fit settings of the whole run where none are given; they differ from those of a single fit.
RUN_DEFAULTS = {"n_components": 40, "alpha": 0.6, "lambda_l1_w": 0.5, "lambda_l1_q": 80.0, "tv_epsilon": 1e-6}


def log_progress(step: str, began: float, **details) -> None:
    """One line of progress: the step, seconds since the start, details."""
    LOG.info("%s after %.1f s %s", step, time.time() - began, " ".join(f"{k}={v}" for k, v in details.items()))


def run_pipeline(expr: DataFrame, obs: DataFrame, preprocess: bool = True, neighbours: int = 8, normalize: bool = True, **settings) -> FitResult:
    """Preprocess, build the graph (one of each sample where there are several), fit, and scale signatures to length 1.

    ``settings`` are those of ``standard_preprocess`` and of the fit; unknown ones are a TypeError before any work.
    """
    of_fit = {f.name for f in fields(FitConfig)}
    of_preprocess = set(signature(standard_preprocess).parameters) - {"expr", "obs"}
    if unknown := sorted(set(settings) - of_fit - of_preprocess - {"subsample"}):
        raise TypeError(f"unknown settings: {', '.join(unknown)}")
    began = time.time()
    if preprocess:
        expr, obs = standard_preprocess(expr, obs, **{k: v for k, v in settings.items() if k in of_preprocess})
        log_progress("preprocessed", began)
    if obs.select("sample_id").distinct().count() > 1:
        lap = per_sample_laplacian(obs, neighbours)
    else:
        lap = laplacian(build_graph(obs, "knn", neighbours), obs, symmetric=True)
    config = FitConfig(**RUN_DEFAULTS | {k: v for k, v in settings.items() if k in of_fit})
    result = fit(expr, obs, lap, config, subsample=settings.get("subsample"))
    log_progress("fitted", began, **{k: v for k, v in result.metadata.items() if k in ("relative_error", "orthogonality")})
    if normalize:
        result.w, result.q = normalize_q_scale_w(result.w, result.q)
        result.metadata["normalized"] = True
    return result
