"""factbase: a PySpark-native engine over immutable facts."""

from .conn import Conn, Subscription
from .db import Db, Diff
from .functions.dates import day, day_at, iso, month, parse_time, plus_days, year
from .query import Query, Stored, TypedQuery
from .rules import Rule, closure
from .schema import Codec, Computed, Datum, Entity, Key, Unique, entity
from .sources.storage import MemoryStorage, ParquetStorage, Storage, TsvStorage
from .terms import avg, count, count_distinct, dense_rank, empty, exists, find, guard, lag, lead, max_, min_, not_, partition_by, rank, row_number, sum_
from .tx import Aborted, Add, AddFrame, Batch, Block, Fn, Lookup, Retract, RetractWhere, SetField, SinceView, TxError, TxReport, UniqueViolation, UnknownEntity, UnknownIdentity, Upsert, UpsertWhere
