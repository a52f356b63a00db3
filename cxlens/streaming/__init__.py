"""Structured Streaming versions of the alerting rules."""

from cxlens.streaming.alerts import (beyond_horizon, current_alerts, delay_alert_stream, detractor_events,
                                     installment_priority_stream, overdue_stream, repeat_alerts,
                                     repeat_pairs_stream, start_batches, start_parquet_sink,
                                     start_repeat_trigger)

__all__ = ["beyond_horizon", "current_alerts", "delay_alert_stream", "detractor_events", "installment_priority_stream",
           "overdue_stream", "repeat_alerts", "repeat_pairs_stream", "start_batches", "start_parquet_sink", "start_repeat_trigger"]
