"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from corpus_context.plans.registry import QUERIES

_MODULES = [
    "corpus_context.plans.q_scan",
    "corpus_context.plans.q_pack",
    "corpus_context.plans.q_select",
    "corpus_context.plans.q_events",
    "corpus_context.plans.q_config",
    "corpus_context.plans.q_stream",
]


def load():
    for m in _MODULES:
        importlib.import_module(m)
    return QUERIES
