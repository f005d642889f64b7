from assetlake.streaming.queues import Queue, fifo_sink, pending_messages, write_batch

__all__ = ["Queue", "fifo_sink", "pending_messages", "write_batch"]
