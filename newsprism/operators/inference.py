"""Batch inference with encoders and generators.

Callers pass a factory that builds the model once per Python worker (later tasks
of the worker find it built): one of their own, the word vectors of
``operators.embed`` or ``class_generator_factory`` here. Encoders run through ``predict_batch_udf`` (Arrow
batches of ``batch_size`` rows); generators through ``mapInPandas`` with
per-row error capture, so a failing article yields an ``error`` row instead of
failing the job.
"""

from __future__ import annotations

import math
import re
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsprism.functions import text as tx
from newsprism.operators import terms as tm

Encoder = Callable[[np.ndarray], np.ndarray]          # texts -> (n, dim) float array
Generator = Callable[[list], str]                     # chat messages -> answer text


def batch_encode(df: DataFrame, make_encoder: Callable[[], Encoder], *, text_col: str = "content",
                 output_col: str = "embedding", batch_size: int = 16, max_tokens: int | None = None) -> DataFrame:
    """Add ``output_col`` (array<float>) from ``make_encoder()`` applied in batches.

    With ``max_tokens`` (512 in the reference's encoder) the encoder gets the text's first
    tokens, lower-cased and joined by spaces; by default it gets the whole text.
    """
    encode = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if max_tokens:
        text = F.array_join(F.slice(tm.tokenize(text), 1, max_tokens), " ")
    return df.withColumn(output_col, encode(text))


GENERATION_SCHEMA = "row_id long, true_label int, answer string, latency_seconds double, error string"


#: Generators that a worker keeps, those used last.
KEPT = 4
_GENERATORS: OrderedDict[str, Generator] = OrderedDict()


def _generator(key: str, make_generator: Callable[[], Generator]) -> Generator:
    """The worker's generator, built by the first task that needs it."""
    if key not in _GENERATORS:
        _GENERATORS[key] = make_generator()
        while len(_GENERATORS) > KEPT:
            _GENERATORS.popitem(last=False)
    _GENERATORS.move_to_end(key)
    return _GENERATORS[key]


def batch_zero_shot(df: DataFrame, make_generator: Callable[[], Generator], *, content_col: str = "content",
                    label_col: str = "label", id_col: str = "row_id") -> DataFrame:
    """Ask the generator for every article; record answer, latency and errors,
    then parse the answer into a label (null when it cannot be read)."""
    prompts = df.select(F.col(id_col).alias("row_id"), F.col(label_col).cast("int").alias("true_label"),
                        tx.build_prompt(content_col).alias("messages"))

    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = _generator(key, make_generator)
        for pdf in batches:
            answers, latencies, errors = [], [], []
            for messages in pdf["messages"]:
                msgs = [{"role": m["role"], "content": m["content"]} for m in messages]
                started = time.perf_counter()
                try:
                    answer = str(generate(msgs)).strip().upper()
                    answers.append(answer)
                    latencies.append(time.perf_counter() - started)
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - kept as data, like the notebook
                    answers.append("")
                    latencies.append(float("nan"))
                    errors.append(str(exc))
            yield pd.DataFrame({"row_id": pdf["row_id"], "true_label": pdf["true_label"], "answer": answers,
                                "latency_seconds": latencies, "error": errors})

    details = prompts.mapInPandas(run, GENERATION_SCHEMA)
    return details.withColumn("latency_seconds", F.nanvl("latency_seconds", F.lit(None).cast("double"))) \
        .withColumn("prediction", tx.parse_binary_answer("answer")) \
        .withColumn("correct", tx.correct_flag("prediction", "true_label"))


# The budgets of the zero-shot call, in tokens.
MAX_INPUT_TOKENS, MAX_NEW_TOKENS = 2048, 5
END = "</s>"
_TOKEN = re.compile(r"\w\w+")


def prompt_tokens(messages: list[dict], budget: int = MAX_INPUT_TOKENS) -> tuple[list[str], list[str]]:
    """(tokens of the instructions, tokens of the article) of a prompt, together cut after ``budget`` tokens."""
    system, user = messages[0]["content"], messages[-1]["content"]
    head = _TOKEN.findall(f"{system}\n{tx.USER_PROMPT_PREFIX}".lower())
    article = _TOKEN.findall(user.removeprefix(tx.USER_PROMPT_PREFIX).lower())
    return head[:budget], article[:max(0, budget - len(head))]


def greedy(next_scores: Callable[[list[str]], dict[str, float]], max_new_tokens: int = MAX_NEW_TOKENS) -> list[str]:
    """Tokens generated one by one: always the best (ties to the lesser token), until END or the budget."""
    out: list[str] = []
    while len(out) < max_new_tokens:
        scores = next_scores(out)
        token = min(scores, key=lambda t: (-scores[t], t))
        if token == END:
            break
        out.append(token)
    return out


def class_generator_factory(model: dict, max_input_tokens: int = MAX_INPUT_TOKENS,
                            max_new_tokens: int = MAX_NEW_TOKENS) -> Callable[[], Generator]:
    """A generator whose first token is the class whose language model gives the article the higher probability.

    ``model`` comes from ``class_language_models``. The prompt is cut to ``max_input_tokens``
    tokens; the answer ends after its class name, or after ``max_new_tokens``.
    """
    def make() -> Generator:
        def generate(messages: list) -> str:
            _, article = prompt_tokens(messages, max_input_tokens)
            first = dict(model["prior"])
            for token in article:
                for name, log_p in zip(first, model["tokens"].get(token, ())):
                    first[name] += log_p

            def next_scores(out: list[str]) -> dict[str, float]:
                return first if not out else {END: 0.0}
            return " ".join(greedy(next_scores, max_new_tokens))
        return generate
    return make


def class_language_models(rows: DataFrame, vocabulary: DataFrame, names: dict[int, str]) -> dict:
    """Per class a smoothed unigram model over the vocabulary, counted by Spark.

    ``rows`` holds label and terms (``terms.term_rows``), ``vocabulary`` its terms (bounded
    by max_features). ``prior`` maps class names to log shares of documents, ``tokens`` each
    term to its log probabilities in the same order: (count + 1) / (all counts + terms).
    """
    labels = sorted(names)
    docs = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    counts = (rows.select("label", F.inline("terms")).join(vocabulary.select("term"), "term").groupBy("term")
              .agg(*[F.coalesce(F.sum(F.when(F.col("label") == v, F.col("tf"))), F.lit(0)).alias(f"c{v}") for v in labels]).collect())
    totals = {v: sum(r[f"c{v}"] for r in counts) for v in labels}
    every = sum(docs.get(v, 0) for v in labels)
    return {"prior": {names[v]: math.log((docs.get(v, 0) + 1) / (every + len(labels))) for v in labels},
            "tokens": {r["term"]: tuple(math.log((r[f"c{v}"] + 1) / (totals[v] + len(counts))) for v in labels) for r in counts}}
