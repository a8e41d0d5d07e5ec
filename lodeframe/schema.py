"""Columns and constants of the record log: sizes, addresses, unsigned ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the log's layout.
FRAME_HEADER = 64
SEGMENT_HEADER = 4096
SEGMENT_FOOTER = 4096
MUTATION_ENTRY = 32
SEAL_FRAME = 128
ABORT_FRAME = 96
NODE_HEADER = 128
NODE_SLOTS = 512
SPARSE_SLOTS = 504
DENSE_NODE = 4160
DELTA_ENTRY = 64
PUT, DELETE = 1, 2

# Frame types in order.
FRAME_TYPES = ("put", "commit_part", "commit_seal", "batch_abort", "id_reserve", "segment_seal", "relocation_part", "relocation_seal", "batch_id_reserve")

_SIGN = -(1 << 63)


def align8(x: Column) -> Column:
    return x + 7 - (x + 7) % 8


def physical(value_bytes: Column) -> Column:
    """Bytes a put frame takes: header and value, padded to 8."""
    return align8(value_bytes + FRAME_HEADER)


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def pack_address(segment: Column, offset: Column) -> Column:
    return F.shiftleft(segment.cast("long"), 32).bitwiseOR(offset.cast("long"))


def address_segment(address: Column) -> Column:
    return F.shiftrightunsigned(address, 32)


def address_offset(address: Column) -> Column:
    return address.bitwiseAND(F.lit(0xFFFFFFFF))


def address_fault(segment: Column, offset: Column) -> Column:
    """The rule an address breaks, or null: a segment above 0, an offset past the header, aligned to 8."""
    return F.when(segment <= 0, "segment").when(offset < SEGMENT_HEADER, "header").when(offset % 8 != 0, "alignment")


def unsigned_order(bits: Column) -> Column:
    """Sorts 64-bit patterns held in a BIGINT as unsigned numbers."""
    return bits.bitwiseXOR(F.lit(_SIGN))


def unsigned_decimal(bits: Column) -> Column:
    """A 64-bit pattern as DECIMAL(20,0)."""
    d = bits.cast("decimal(20,0)")
    return F.when(bits < 0, d + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d)


def node_bytes(slots: Column) -> Column:
    """Size of a radix node with so many used slots."""
    return F.when(slots < SPARSE_SLOTS, NODE_HEADER + 8 * slots).otherwise(DENSE_NODE).cast("long")


def radix_slot(id_: Column, level: int) -> Column:
    return F.shiftrightunsigned(id_, 9 * level).bitwiseAND(F.lit(NODE_SLOTS - 1))


def radix_prefix(id_: Column, level: int) -> Column:
    return F.shiftrightunsigned(id_, 9 * (level + 1)) if level < 7 else F.lit(0).cast("long")
