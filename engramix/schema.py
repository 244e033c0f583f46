"""Record types, scopes and options of the engine."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "struct<name:string,attention_weight:double,entity_type:string>"
MESSAGES = "scope string, msg_seq bigint, role string, content string, ts timestamp"
MEMORIES = (
    "id string, scope string, user_id string, agent_id string, run_id string, actor_id string, role string, data string, hash string, "
    "text_lemmatized string, created_at string, updated_at string, speaker string, graph_object string, "
    f"entities array<{ENTITY}>, source_raw_sentence_ids array<string>, source_raw_texts array<string>, prev_id string, next_id string, "
    "unit_confidence double, vector array<float>, metadata map<string,string>"
)
HISTORY = "memory_id string, old_memory string, new_memory string, event string, created_at string, updated_at string, actor_id string, role string, is_deleted int"
NODES = "name string, scope string, attention_weight_sum double, entity_type string, summary string, summary_facts array<string>"
NODE_LINKS = "name string, sentence_id string, scope string"
EDGES = "head string, tail string, type string, source_id string, scope string, confidence double, source_fact_id string, source_fact string, source_unit_id string, source_fact_memory_id string"
ENTITY_INDEX = "entity_id string, data string, entity_type string, linked_memory_ids array<string>, scope string, vector array<float>"
RUNS = "id string, template_id string, project_name string, benchmark string, status string, config string, env_overrides string, pid bigint, log_file string, result_file string, started_at string, finished_at string, created_at string"

SCOPE_IDS = ("agent_id", "run_id", "user_id")


def empty(spark, schema: str):
    return spark.createDataFrame([], schema)


def checked_id(name: str, value: object) -> str | None:
    """An id without surrounding space; it must be text, not empty and without white space."""
    if value is None:
        return None
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a non-empty string")
    if re.search(r"\s", value.strip()):
        raise ValueError(f"{name} must not contain white space")
    return value.strip()


def checked_scope(**ids: str | None) -> dict[str, str]:
    """The ids that are given; one at least."""
    found = {k: v for k in SCOPE_IDS if (v := checked_id(k, ids.get(k)))}
    if not found:
        raise ValueError("one of user_id, agent_id and run_id is required")
    return found


def scope_key(ids: dict[str, str]) -> str:
    """agent_id=..&run_id=..&user_id=.., without those that aren't given."""
    return "&".join(f"{k}={ids[k]}" for k in SCOPE_IDS if ids.get(k))


def scope_column() -> Column:
    """The same of rows that have the three id columns."""
    return F.concat_ws("&", *(F.when(F.coalesce(F.col(k), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.col(k))) for k in SCOPE_IDS))


def checked_search(threshold: float | None, top_k: int) -> None:
    if threshold is not None and not 0 <= threshold <= 1:
        raise ValueError("threshold must be within [0, 1]")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 0:
        raise ValueError("top_k must be a non-negative integer")


@dataclass(frozen=True)
class Options:
    """Switches and sizes of ingestion and search."""

    segmentation_strategy: str = "nlp"
    relation_batch_size: int = 20
    edge_entity_threshold: int = 0
    use_bfs: bool = True
    use_rerank: bool = True
    use_entity_boost: bool = True
    use_entity_match: bool = False
    use_entity_store: bool = True
    use_history: bool = True
    use_dedup: bool = True
    dedup_across_scopes: bool = False
    build_evidence_units: bool = True
    index_graph_facts: bool = True
    index_entity_summaries: bool = True
    use_context_window: bool = False
    graph_context_window: int = 4
    bm25_weight: float = 1.0
    linear_rag_enabled: bool = False
    linear_rag_threshold: float = 0.3
    linear_rag_rounds: int = 2
    embedding_dims: int = 384
    entity_threshold: float = 0.95
    path_threshold: float = 0.25
    max_hops: int = 3
    tolerance: int = 2

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "MEMORY_") -> Options:
        """Values from environment variables; true, 1 and yes are true."""
        given = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(getattr(cls, f.name))
                given[f.name] = raw.lower() in ("true", "1", "yes") if kind is bool else kind(raw)
        return cls(**given)


def expanded(value: object, env: dict[str, str]) -> object:
    """${NAME} in all texts of a nested configuration, from the environment (unknown names: empty)."""
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), value) if isinstance(value, str) else value


# Settings that hold secrets, by name or ending.
SECRET_NAMES = ("api_key", "password", "secret", "token", "credentials", "access_key", "private_key")


def redacted(config: dict) -> dict:
    """A configuration with the values of secret settings replaced."""
    secret = lambda k: any(k.lower() == s or k.lower().endswith("_" + s) for s in SECRET_NAMES)
    return {k: redacted(v) if isinstance(v, dict) else "***" if secret(k) and v else v for k, v in config.items()}


@dataclass
class Scope:
    ids: dict[str, str] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return scope_key(self.ids)
