"""Operator 3, chat formatting: conversations rendered by a compiled template, with generation markers.

Turns of a conversation are gathered by conv_id and ordered by (turn, role, text), nulls first. The template (see
template.py) is compiled once per task. ``starts`` and ``ends`` are the character spans that a model is trained to
generate.

Defined results. Null role: ``user``. Null text: empty. A null conv_id names no conversation: each of its turns is
rendered by itself, so that they don't gather in one row.
Repeated rows are rendered each. Empty table: no rows. Further columns are ignored. A template that fails on a
conversation fails the job, as a silent gap would not be seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.template import compile_template

TEMPLATE = """\
{%- for m in messages -%}
{{ '<|im_start|>' + m.role + '\n' }}
{%- if m.role == 'assistant' -%}
{% generation %}{{ m.content + '<|im_end|>' }}{% endgeneration %}
{%- else -%}
{{ m.content + '<|im_end|>' }}
{%- endif -%}
{{ '\n' }}
{%- endfor -%}"""


def _render(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for batch in batches:
            rows = [
                render({"messages": [{"role": "user" if m["role"] is None else m["role"], "content": m["text"] or "", "turn": m["turn"]} for m in turns]})
                for turns in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([t for t, _ in rows], pa.string()),
                    pa.array([[a for a, _ in s] for _, s in rows], pa.list_(pa.int64())),
                    pa.array([[b for _, b in s] for _, s in rows], pa.list_(pa.int64())),
                    pa.array([sum(b - a for a, b in s) for _, s in rows], pa.int64()),
                ],
                ["conv_id", "text", "starts", "ends", "n_generated"],
            )

    return run


def render_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Rows (conv_id, text, starts, ends, n_generated), one per conversation."""
    compile_template(template)  # a wrong template fails here rather than in a task
    one = F.struct("turn", "role", "text")
    whole = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one), _order).alias("turns"))
    whole = whole.unionByName(turns.where("conv_id is null").select("conv_id", F.array(one).alias("turns")))
    out = "conv_id long, text string, starts array<long>, ends array<long>, n_generated long"
    return whole.mapInArrow(_render(template), out)


def _order(a, b):
    """Compares turns by (turn, role, text), nulls first, as an expression."""
    e = F.lit(0)
    for f in ("text", "role", "turn"):
        x, y = a[f], b[f]
        e = (
            F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1)
            .when(x < y, -1).when(x > y, 1).otherwise(e)
        )
    return e


SQL = """
WITH t AS (
  SELECT conv_id, lone, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
    '<|im_start|>' || coalesce(role, 'user') || chr(10) AS head, coalesce(text, '') || '<|im_end|>' AS body,
    coalesce(role = 'assistant', false) AS gen
  FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations)),
p AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, lone ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM t)
SELECT conv_id, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
  coalesce(list(start::BIGINT ORDER BY k) FILTER (WHERE gen), []) AS starts,
  coalesce(list((start + length(body))::BIGINT ORDER BY k) FILTER (WHERE gen), []) AS ends,
  coalesce(sum(length(body)) FILTER (WHERE gen), 0)::BIGINT AS n_generated
FROM p GROUP BY conv_id, lone
"""


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 3 over conversations."""
    return render_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
