"""Registered streaming queries.

Each runs its Structured Streaming job over the driver events table until the
source is drained (``availableNow``) and returns what the job wrote, so the
result can be compared with the batch operators (V3, B2).
"""

from __future__ import annotations

from ..streaming import basket_feed, view_history
from .registry import register


@register("stream_record_views")
def q_stream_record_views(t):
    out = view_history.stream_record_views(t.spark, t.sf_dir)
    return view_history.read_history(t.spark, out)


def _feed(t):
    return basket_feed.stream_basket_feed(t.spark, t.sf_dir)


@register("stream_basket_feed")
def q_stream_basket_feed(t):
    return basket_feed.final_basket(t.spark, _feed(t))


@register("stream_basket_feed_messages")
def q_stream_basket_feed_messages(t):
    return basket_feed.read_feed(t.spark, _feed(t)).select("customer_id", "message")
