"""What is checked on requests, keys, frames and nodes before they are used, as columns: null where all is well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefixlake.operators.registry import is_identifier

#: Limits in bytes.
KEY_BYTES, FRAME_KEY_BYTES, FRAME_VALUE_BYTES, UNARY_BYTES = 64 << 10, 1024, 64 << 10, 4 << 20


def resolved_namespace(source: Column, static: Column, header: Column, credential: Column, path: Column, api_keys: Column, routes: Column) -> Column:
    """The tenant of a request by its source (static, header, api_key, route); null if none or no identifier. api_keys and routes are maps; a bearer prefix is cut off."""
    key = F.coalesce(credential, F.lit(""))
    key = F.when(F.lower(key).startswith("bearer "), F.trim(F.substring(key, 8, 1 << 30))).otherwise(key)
    value = F.when(source == "static", static).when(source == "header", header).when(source == "api_key", F.try_element_at(api_keys, key)).when(source == "route", F.try_element_at(routes, path))
    return F.when(is_identifier(value), value)


def key_problem(key: Column, most: int = KEY_BYTES) -> Column:
    return F.when(F.coalesce(F.octet_length(key), F.lit(0)) == 0, "empty").when(F.octet_length(key) > most, "too_long")


def frame_problem(opcode: Column, key: Column, value: Column, most_key: int = FRAME_KEY_BYTES, most_value: int = FRAME_VALUE_BYTES) -> Column:
    """The first of: opcode (none of 1 to 3), key (empty or too long), value (too long, or there without a SET)."""
    size = F.coalesce(F.octet_length(value), F.lit(0))
    return F.when(~F.coalesce(opcode.between(1, 3), F.lit(False)), "opcode").when(key_problem(key, most_key).isNotNull(), "key").when((size > most_value) | ((opcode != 2) & (size > 0)), "value")


def read_mode(size: Column, most: int = UNARY_BYTES) -> Column:
    return F.when(size > most, "chunked").otherwise("unary")


def ack_problem(enabled: Column, has_topology: Column, is_primary: Column, required: Column, replicas: Column) -> Column:
    """Why a write can't get its acks, the first of: disabled, no_topology, not_primary, too_many."""
    return F.when(~enabled, "disabled").when(~has_topology, "no_topology").when(~is_primary, "not_primary").when(required > replicas, "too_many")


def node_problem(role: Column, node_id: Column, address: Column) -> Column:
    """What is wrong with a node's entry, the first of: role, control_identity, node_id, address (host:port, port 1 to 65535)."""
    text = F.coalesce(address, F.lit(""))
    port = F.regexp_extract(text, r":(\d{1,5})\z", 1)
    at = text.rlike(r"\A([^:\s\[\]]+|\[[^\[\]\s]+\]):\d{1,5}\z") & F.coalesce(F.try_to_number(F.when(port != "", port), F.lit("99999")).between(1, 65535), F.lit(False))
    none = (F.coalesce(node_id, F.lit("")) == "") & (text == "")
    return (
        F.when(~F.coalesce(role.isin("control", "data"), F.lit(False)), "role")
        .when((role == "control") & ~none, "control_identity")
        .when((role == "data") & ~F.coalesce(is_identifier(node_id), F.lit(False)), "node_id")
        .when((role == "data") & ~at, "address")
    )
