"""Spark-native analytics for key-value workloads.

A mutation log is a DataFrame or a stream; keyspace state, expiry, slots,
replication, tiering and rebalancing are set-oriented operators over it.
"""
