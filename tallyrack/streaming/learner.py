"""The prequential learner as keyed state, with snapshots that another stream can start from.

Rows: stream_id, seq, observation_id, partition, context, outcome and, if
given, kind.  Each is predicted, then learned from, as ``operators.learning``
does over windows; rows of kind ``score`` are predicted only.

State is typed: one row of sums, a map of counts by expert and key, a map of
accepted ids.  A trigger reads and writes the entries that its rows touch, so
its work grows with them and not with what was accepted before.  A new stream's
state is empty and not asked for; a batch has no later trigger and writes none.
Rows of a key in one trigger are taken by seq and held together.

``snapshot`` reads the state of a stopped stream as one table; ``faults`` says
what is wrong with such a table; ``restored`` refuses it then, and otherwise is
the ``initial`` state of a new stream, which goes on as the old one would have.

Rows without a context, and rows to learn from without an id, are
``invalid_schema``; rows past ``most_ids`` or ``most_contexts`` are
``resource_limit``.  Neither changes the state.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tallyrack.operators import validate

from .rocks import in_order, known

OUT = "stream_id long, seq long, p_mix double, log_score double, status string"
SUMS = "accepted long, completed long, s_global double, s_context double, s_previous double, mixture double, prev string, streaming boolean, contexts long"
SNAPSHOT = "stream_id long, kind string, key string, seen long, completed long, number double, text string"
LIBRARY = "global-context-previous-beta-1-1-v1"
EXPERTS = ("global", "context", "previous")
#: scores are logarithms of probabilities; more than this above 0 is a fault
ROUNDING = 1e-15


class Learner(StatefulProcessor):
    def __init__(self, most_ids: int, most_contexts: int, keep: bool = True):
        self.most_ids, self.most_contexts, self.keep = most_ids, most_contexts, keep

    def init(self, handle) -> None:
        self.sums = handle.getValueState("sums", SUMS)
        self.counts = handle.getMapState("counts", "kind string, key string", "seen long, completed long")
        self.ids = handle.getMapState("ids", "observation_id string", "number long, partition string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Takes a snapshot's rows, which may come in several frames."""
        found = list(self.sums.get()) if self.sums.exists() else [0, 0, 0.0, 0.0, 0.0, 0.0, "start", False, 0]
        for r in initialState.itertuples(index=False):
            if r.kind in EXPERTS:
                self.counts.updateValue((r.kind, r.key), (int(r.seen), int(r.completed)))
                found[8] += r.kind == "context"
                if r.kind == "global":
                    found[0], found[1] = int(r.seen), int(r.completed)
            elif r.kind == "id":
                self.ids.updateValue((r.key,), (int(r.seen), r.text))
            elif r.kind == "score":
                found[2 + ("global", "context", "previous", "mixture").index(r.key)] = float(r.number)
            elif r.key == "prev":
                found[6] = r.text
            elif r.key == "streaming":
                found[7] = r.text == "true"
        self.sums.update(tuple(found))

    def handleInputRows(self, key, rows, timerValues):
        found = self.sums.get() if self.sums.exists() else None
        accepted, completed, *scores, mixture, prev, streaming, contexts = found or (0, 0, 0.0, 0.0, 0.0, 0.0, "start", False, 0)
        counts: dict = {}
        fresh: dict = {}
        changed = set()

        def count(at):
            if at not in counts:
                counts[at] = tuple(self.counts.getValue(at)) if found and self.counts.containsKey(at) else (0, 0)
            return counts[at]

        out = []
        for row in in_order(rows).itertuples(index=False):
            seq, context, scored = known(row.seq), known(row.context), row.kind == "score"
            status = "scored" if scored else "accepted"
            if context is None:
                status = "invalid_schema"
            elif scored:
                pass
            elif row.partition not in ("training", "streaming"):
                status = "unauthorized"
            elif row.partition == "training" and streaming:
                status = "late_training"
            elif row.outcome not in ("completed", "not_completed"):
                status = "non_result"
            elif known(row.observation_id) is None:
                status = "invalid_schema"
            elif row.observation_id in fresh or found and self.ids.containsKey((row.observation_id,)):
                status = "duplicate"
            elif accepted >= self.most_ids or (contexts >= self.most_contexts and not count(("context", context))[0]):
                status = "resource_limit"
            if status not in ("accepted", "scored"):
                out.append((key[0], seq, None, None, status))
                continue
            keys = (("global", "all"), ("context", context), ("previous", prev))
            p = [(count(k)[1] + 1) / (count(k)[0] + 2) for k in keys]
            top = max(scores)
            weights = [math.exp(s - top) for s in scores]
            mix = sum(a * b for a, b in zip(weights, p, strict=True)) / sum(weights)
            if scored:
                out.append((key[0], seq, mix, None, status))
                continue
            y = row.outcome == "completed"
            gain = math.log(mix if y else 1 - mix)
            out.append((key[0], seq, mix, gain, status))
            contexts += not count(keys[1])[0]
            for i, k in enumerate(keys):
                counts[k] = (counts[k][0] + 1, counts[k][1] + y)
                changed.add(k)
                scores[i] += math.log(p[i] if y else 1 - p[i])
            accepted, completed, mixture, prev = accepted + 1, completed + y, mixture + gain, str(int(y))
            streaming = streaming or row.partition == "streaming"
            fresh[row.observation_id] = (accepted, row.partition)
        if self.keep:
            for k in changed:
                self.counts.updateValue(k, counts[k])
            for k, v in fresh.items():
                self.ids.updateValue((k,), v)
            self.sums.update((accepted, completed, *scores, mixture, prev, streaming, contexts))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "p_mix", "log_score", "status"]).astype({"seq": "Int64", "p_mix": "float64", "log_score": "float64"})

    def close(self) -> None:
        pass


def learned(rows: DataFrame, initial: DataFrame | None = None, most_ids: int = 1_000_000, most_contexts: int = 10_000) -> DataFrame:
    """One row of OUT for each input row; ``rows`` may be a stream or a batch.  Run it inside ``rocks.state_on_disk``."""
    if "kind" not in rows.columns:
        rows = rows.withColumn("kind", F.lit("learn"))
    return rows.groupBy("stream_id").transformWithStateInPandas(Learner(most_ids, most_contexts, rows.isStreaming), OUT, "append", "none", initial.groupBy("stream_id") if initial is not None else None)


def snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """SNAPSHOT rows of every stream whose state the checkpoint holds."""
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    none = "CAST(NULL AS BIGINT) seen, CAST(NULL AS BIGINT) completed"
    sums = state("sums").selectExpr("key.stream_id", "value.*").where("accepted > 0")
    scores = sums.selectExpr("stream_id", "stack(4, 'global', s_global, 'context', s_context, 'previous', s_previous, 'mixture', mixture) AS (key, number)").selectExpr("stream_id", "'score' kind", "key", none.split(", ")[0], none.split(", ")[1], "number", "CAST(NULL AS STRING) text")
    flags = sums.selectExpr("stream_id", f"stack(3, 'prev', prev, 'streaming', CAST(streaming AS STRING), 'library', '{LIBRARY}') AS (key, text)").selectExpr("stream_id", "'flag' kind", "key", *none.split(", "), "CAST(NULL AS DOUBLE) number", "text")
    counts = state("counts").selectExpr("key.stream_id", "user_map_key.kind", "user_map_key.key", "user_map_value.seen", "user_map_value.completed", "CAST(NULL AS DOUBLE) number", "CAST(NULL AS STRING) text")
    ids = state("ids").selectExpr("key.stream_id", "'id' kind", "user_map_key.observation_id key", "user_map_value.number seen", "CAST(NULL AS BIGINT) completed", "CAST(NULL AS DOUBLE) number", "user_map_value.partition text")
    return scores.unionByName(flags).unionByName(counts).unionByName(ids)


def faults(found: DataFrame, most_ids: int = 1_000_000, most_contexts: int = 10_000) -> DataFrame:
    """stream_id, faults: what a restore must refuse, joined by commas; a sound stream has no row."""
    expert = F.col("kind").isin(*EXPERTS)
    basic = validate.snapshot_issues(found.where(expert), found.where("kind = 'id'").select("stream_id", F.col("key").alias("observation_id")))
    of = lambda kind, key: (F.col("kind") == kind) & (F.col("key") == key)
    fails = lambda c: F.coalesce(~c, F.lit(True))
    one_id = F.col("kind") == "id"
    per = found.groupBy("stream_id").agg(
        F.count_if(F.col("kind") == "score").alias("scores"), F.count_distinct(F.when(F.col("kind") == "score", F.col("key"))).alias("kinds"),
        F.max((F.col("kind") == "score") & fails(F.col("key").isin(*EXPERTS, "mixture") & (F.col("number") <= ROUNDING) & (F.col("number") > float("-inf")))).alias("score"),
        F.count_if(F.col("kind") == "flag").alias("flags"), F.max(F.when(of("flag", "library"), F.col("text"))).alias("library"), F.max(F.when(of("flag", "prev"), F.col("text"))).alias("prev"),
        F.max(F.when(of("flag", "streaming"), F.col("text"))).alias("streaming"), F.count_if(one_id).alias("ids"), F.count_if(F.col("kind") == "context").alias("contexts"),
        F.max((F.col("kind") == "context") & F.col("key").isNull()).alias("no_context"), F.max((F.col("kind") == "previous") & fails(F.col("key").isin("start", "0", "1"))).alias("previous"), F.max(fails(expert | F.col("kind").isin("score", "flag", "id"))).alias("kind"),
        F.max(one_id & fails(F.col("text").isin("training", "streaming"))).alias("partition"), F.count_distinct(F.when(one_id, F.col("seen"))).alias("numbers"), F.min(F.when(one_id, F.col("seen"))).alias("first"), F.max(F.when(one_id, F.col("seen"))).alias("last"),
        F.min(F.when(one_id & (F.col("text") == "streaming"), F.col("seen"))).alias("opened"), F.max(F.when(one_id & (F.col("text") == "training"), F.col("seen"))).alias("trained"))
    rules = [
        (fails((F.col("scores") == 4) & (F.col("kinds") == 4) & ~F.col("score")), "scores"), (fails(F.col("library") == LIBRARY), "library"), (fails(F.col("flags") == 3), "flags"), (fails(F.col("prev").isin("0", "1")), "prev"), (F.col("kind"), "kind"),
        (F.col("no_context"), "context"), (F.col("previous"), "previous"), (F.col("partition"), "partition"), (fails((F.col("numbers") == F.col("ids")) & (F.col("first") == 1) & (F.col("last") == F.col("ids"))), "order"),
        (fails(F.col("streaming") == F.when(F.col("opened").isNotNull(), "true").otherwise("false")), "streaming"), (F.coalesce(F.col("trained") > F.col("opened"), F.lit(False)), "late_training"), (F.col("ids") > most_ids, "most_ids"), (F.col("contexts") > most_contexts, "most_contexts"),
    ]
    own = per.select("stream_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda x: x.isNotNull())).alias("fault"))
    both = own.unionByName(basic.select("stream_id", F.explode(F.split("issues", ",")).alias("fault")))
    return both.groupBy("stream_id").agg(F.array_join(F.array_sort(F.collect_set("fault")), ",").alias("faults"))  # some twenty kinds


def restored(found: DataFrame, **limits: int) -> DataFrame:
    """``found`` as an initial state; a ValueError if any stream in it has faults."""
    bad = faults(found, **limits).orderBy("stream_id").limit(5).collect()  # named in the error only
    if bad:
        raise ValueError("snapshot refused: " + "; ".join(f"stream {r['stream_id']}: {r['faults']}" for r in bad))
    return found.select(*[c.split()[0] for c in SNAPSHOT.split(", ")])
