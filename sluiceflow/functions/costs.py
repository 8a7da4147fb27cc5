"""Prices and cost columns. Every price is a parameter of the functions below."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price per 100 ms by memory size in MB.
MEMORY_PRICES = {128: 2.08e-7, 256: 4.17e-7, 512: 8.34e-7, 1024: 1.667e-6, 3008: 4.897e-6}
# Price per 1000 write or list requests, and per 1000 read requests.
WRITE_PRICE = 0.005
READ_PRICE = 0.0004
# Fixed value: price per hour of the machine the comparison system needs.
MACHINE_PRICE = 4.256
# Fixed value: storage price per GiB and month.
STORAGE_PRICE = 0.023
# Fixed value: memory size at which a function has two virtual CPUs.
FULL_MEMORY = 3008

# Memory of each event type when the events table stands for a run log.
STAGE_MEMORY = {"view": 128, "click": 256, "error": 512, "signup": 1024, "purchase": 3008}


def lookup(table: dict, key: Column) -> Column:
    """A value of a small constant table."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.element_at(F.create_map(*pairs), key)


def memory_rate(memory: Column) -> Column:
    return lookup(MEMORY_PRICES, memory)


def billed_units(duration_ms: Column, round_up: bool = True) -> Column:
    """Blocks of 100 ms that were started, or with `round_up=False` finished."""
    started = duration_ms + 99 if round_up else duration_ms
    return F.floor(started / 100).cast("bigint")


def compute_cost(duration_ms: Column, rate: Column, round_up: bool = True) -> Column:
    """Billed blocks × price as a decimal, so that sums do not depend on row order."""
    return billed_units(duration_ms, round_up).cast("decimal(20,0)") * rate.cast("decimal(12,9)")


def request_cost(writes: Column, lists: Column, reads: Column) -> Column:
    return (writes + lists) / 1000.0 * WRITE_PRICE + reads / 1000.0 * READ_PRICE


def machine_cost(elapsed_seconds: Column, per_hour: float = MACHINE_PRICE) -> Column:
    return elapsed_seconds * per_hour / 3600.0


def virtual_cpus(memory: Column) -> Column:
    return memory * 2.0 / FULL_MEMORY
