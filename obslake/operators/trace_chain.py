"""The order in which traces are tapped: edges, then span metrics, then head and tail sampling.

What is derived sees all spans; sampling decides only what is exported. In batch the branches are separate queries over one input; on streams the chain
runs inside foreachBatch, on one cached batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import sampling, service_graph, spans


@dataclass(frozen=True)
class TraceChain:
    policies: list[sampling.Policy]
    head_share: float = 1.0
    keep_errors: bool = True
    dims: tuple[str, ...] = ()
    wait_ms: int | None = None


def run_trace_chain(table: DataFrame, chain: TraceChain) -> dict[str, DataFrame]:
    """edges, red and decisions, and exported: the spans of sampled traces among those that head sampling keeps."""
    head = table if chain.head_share >= 1 else sampling.head_sample(table, chain.head_share, chain.keep_errors)
    return {
        "edges": service_graph.edge_metrics(service_graph.pair(table)),
        "red": spans.span_red(table, chain.dims),
        "decisions": sampling.decide(head, chain.policies, wait_ms=chain.wait_ms),
        "exported": sampling.keep(head, chain.policies, wait_ms=chain.wait_ms),
    }


def batch_writer(chain: TraceChain, write: Callable[[str, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each output of the chain is given to write(name, rows, batch number); the batch is read once."""

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for name, out in run_trace_chain(rows, chain).items():
                write(name, out, number)
        finally:
            rows.unpersist()

    return run
