"""Defaults and vocabularies. All of them are parameters of the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    max_age_days: int = 30
    max_items: int = 40
    dim: int = 256
    threshold: float = 0.92
    entities_per_item: int = 12
    window_days: int = 30
    convergence_weight: float = 1.0
    degree_weight: float = 0.5
    recency_weight: float = 0.5
    signal_weight: float = 1.0
    min_sources: int = 2
    feedback_weight: float = 2.0
    digest_days: int = 7
    high_hype: int = 4
    section_limit: int = 8
    retrieve_limit: int = 40


DEFAULTS = Params()

# Names that results carry.
SOURCE_TYPES = ("rss", "github_releases", "arxiv", "github_star_velocity", "github_new_repos", "github_advisories", "github_changes")
TRUST_LEVELS = ("high", "medium", "low")
CLASSES = ("immediate_priority", "operational_update", "horizon_signal", "archive")
QUADRANT = ("horizon_signal", "archive")
ACTIONS = {"useful": 1.0, "save": 1.0, "not_useful": -1.0, "ignore": -1.0}
HIDE = "ignore"
ENTITY_LABELS = {"org": "Org", "model": "Model", "person": "Person", "tool": "Tool", "concept": "Concept"}
NODE_LABELS = ("Item", "Source", "Entity", "Event", "Topic", "Org", "Model", "Person", "Tool", "Concept")
EDGE_TYPES = ("FROM", "IN_EVENT", "MENTIONS", "INTERACTS_WITH", "ABOUT", "SIMILAR_TO")
HORIZONS = ("near", "mid", "far")

# Words that rules look for.
STACK_WORDS = (
    "python", "fastapi", "sqlite", "qdrant", "neo4j", "react", "typescript",
    "llm", "rag", "vector", "graph", "embedding", "agent", "anthropic", "claude",
    "openai", "transformer", "retrieval",
)
ACTION_WORDS = ("release", "released", "breaking", "deprecat", "security", "advisory", "cve")
RESEARCH_WORDS = ("research", "paper", "preprint")
TOOL_WORDS = ("release", "tool", "framework", "library", "update", "changelog")
RISK_WORDS = ("security", "advisory", "vulnerability", "deprecation", "breaking", "cve", "exploit")

# Headings of the digest, in order.
HEADINGS = (
    "Executive summary",
    "Must-know",
    "Should-read",
    "Weak signals",
    "Research radar",
    "Tool changes",
    "Risks",
    "Opportunities",
    "Suggested experiments",
    "Ignored / noise count",
)
#: The listed sections, by heading from the second on.
SECTIONS = ("must_know", "should_read", "weak_signals", "research_radar", "tool_changes", "risks", "opportunities", "suggested_experiments")
