"""Token array expressions: budgets, label masks and padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label for positions outside the completion; tokens per word budget.
IGNORE = -100
SEQUENCE_LIMIT = {250: 1024, 500: 1024, 1000: 2048, 1500: 2048, 2000: 4096}


def truncate_prompt(prompt: Column, completion: Column, limit: int) -> Column:
    """Prompt cut so that prompt and completion fit the limit."""
    room = F.greatest(F.lit(limit) - F.size(completion), F.lit(0))
    return F.slice(prompt, F.lit(1), room)


def sequence_ids(prompt: Column, completion: Column, limit: int) -> Column:
    return F.concat(truncate_prompt(prompt, completion, limit), completion)


def sequence_labels(prompt: Column, completion: Column, limit: int) -> Column:
    kept = F.size(truncate_prompt(prompt, completion, limit))
    return F.concat(F.array_repeat(F.lit(IGNORE), kept), completion)


def pad_right(ids: Column, size: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(size - F.size(ids), F.lit(0))))


def pad_left(ids: Column, size: Column, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(size - F.size(ids), F.lit(0))), ids)


def attention_mask(ids: Column, size: Column) -> Column:
    n = F.size(ids)
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(size - n, F.lit(0))))
