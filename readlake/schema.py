"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_f = T.StructField

READS = T.StructType([
    _f("file_idx", T.IntegerType()), _f("block_idx", T.IntegerType()), _f("ordinal", T.LongType()), _f("mate", T.IntegerType()),
    _f("pair_id", T.LongType()), _f("name", T.StringType()), _f("seq", T.StringType()), _f("comment", T.StringType()), _f("qual", T.StringType()),
])
BLOCKS = T.StructType([
    _f("file_idx", T.IntegerType()), _f("block_idx", T.IntegerType()), _f("read_count", T.LongType()), _f("bases", T.LongType()),
    _f("bytes", T.LongType()), _f("offset", T.LongType()), _f("onech", T.BooleanType()), _f("longseq", T.BooleanType()),
])
FILES = T.StructType([_f("file_idx", T.IntegerType()), _f("path", T.StringType())])
REF = T.StructType([_f("contig", T.StringType()), _f("contig_start", T.LongType()), _f("seq", T.StringType())])

#: Bases beyond which a read counts as long.
LONG_READ = 65536
