"""Operators over command logs and long-form keyspace state."""
