"""A durable, bounded delivery log between rendering and a sink.

``offer`` stores a rendered batch and returns; ``drain`` delivers what is
stored, oldest first. At most ``depth`` batches wait: offering one more drains
first, so a slow sink slows its producer down. A batch whose delivery fails is
dropped from the queue, so that the next ones go on, but kept: ``dropped``
lists it with the error, and ``redrive`` delivers it later, once, in order.

All state is folders in the cluster's shared storage: ``waiting/batch_id=N``
and ``dropped/batch_id=N`` hold the rows, and an empty file ``done/N`` the
batches that were delivered. A batch offered again after it was taken changes
nothing, so a stream's replayed batch is delivered once. A job that is lost
between a delivery and its mark delivers again: deliveries replace their own
batch (``text_delivery``) or commit by batch id (two-phase writers).
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from lagscope import schemas as S
from lagscope.sinks.runner import Deliver, Render
from lagscope.streaming.jobs import _batches, _path, _path_exists, publish

log = logging.getLogger("lagscope.sinks")


class DeliveryLog:
    def __init__(self, spark: SparkSession, root: str, deliver: Deliver, depth: int = S.SINK_QUEUE_DEPTH):
        if depth < 1:
            raise ValueError("depth must be 1 or more")
        self.spark, self.root, self.deliver, self.depth = spark, root.rstrip("/"), deliver, depth

    def _done(self, batch_id: int) -> bool:
        return _path_exists(self.spark, f"{self.root}/done/{batch_id}")

    def waiting(self) -> list[int]:
        return sorted(_batches(self.spark, f"{self.root}/waiting"))

    def dropped(self) -> dict[int, str]:
        """Batch id -> error of the dropped batches."""
        out = {}
        for b in sorted(_batches(self.spark, f"{self.root}/dropped")):
            out[b] = "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/errors/{b}").collect())
        return out

    def offer(self, rendered: DataFrame, batch_id: int) -> None:
        """Stores a batch; a full log is drained first."""
        if self._done(batch_id) or batch_id in self.dropped():
            return
        if len(self.waiting()) >= self.depth:
            self.drain()
        publish(rendered, f"{self.root}/waiting", batch_id)

    def _deliver(self, kind: str, batch_id: int) -> Exception | None:
        fs, path = _path(self.spark, f"{self.root}/{kind}/batch_id={batch_id}")
        if not self._done(batch_id):
            try:
                self.deliver(self.spark.read.parquet(f"{self.root}/{kind}/batch_id={batch_id}"), batch_id)
            except Exception as e:  # noqa: BLE001 - the log keeps what failed
                return e
            fs.create(_path(self.spark, f"{self.root}/done/{batch_id}")[1], True).close()
        fs.delete(path, True)
        return None

    def drain(self) -> list[int]:
        """Delivers what waits, oldest first; the batches dropped on the way."""
        out = []
        for b in self.waiting():
            if (error := self._deliver("waiting", b)) is not None:
                log.error("sink batch %s dropped: %s", b, error)
                self.spark.createDataFrame([(str(error)[:2000],)], "error string").coalesce(1).write.mode(
                    "overwrite").text(f"{self.root}/errors/{b}")
                fs, path = _path(self.spark, f"{self.root}/waiting/batch_id={b}")
                fs.mkdirs(_path(self.spark, f"{self.root}/dropped")[1])
                fs.rename(path, _path(self.spark, f"{self.root}/dropped/batch_id={b}")[1])
                out.append(b)
        return out

    def redrive(self) -> list[int]:
        """Delivers the dropped batches, oldest first, until one fails; the
        batches delivered."""
        out = []
        for b in sorted(_batches(self.spark, f"{self.root}/dropped")):
            if self._deliver("dropped", b) is not None:
                break
            out.append(b)
        return out


def logged_sink(render: Render, delivery_log: DeliveryLog):
    """For ``foreachBatch``: batches are rendered, stored and delivered."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        delivery_log.offer(render(batch), batch_id)
        delivery_log.drain()
    return per_batch
