"""Hand-made rows with defaults for every column."""

from __future__ import annotations

from datetime import datetime

OBSERVATION = (
    "package string, device_key string, build string, partition string, device_path string, observed_at timestamp_ntz, "
    "label string, label_unresolved boolean, version_code bigint, priv_app boolean, cert_issuer string, cert_subject string, "
    "core_app boolean, shared_user_id string, persistent boolean, has_code boolean, overlay_target string, overlay_static boolean, "
    "is_input_method boolean, is_device_admin boolean, is_accessibility_service boolean, is_carrier_service boolean, "
    "libraries array<struct<name:string,version:int>>, static_libraries array<struct<name:string,version:int>>, "
    "uses_libraries_required array<string>, uses_libraries_optional array<string>, protected_broadcasts array<string>, "
    "provider_authorities array<string>, queries_packages array<string>, content_uri_authorities array<string>, "
    "intent_filters array<struct<component:string,component_class:string,actions:array<string>,categories:array<string>,priority:int>>, "
    "icon_bytes binary, icon_mime string"
)
CORPUS = (
    "package string, devices array<string>, partitions array<string>, device_count int, priv_app boolean, core_app boolean, "
    "persistent boolean, shared_user_id string, overlay_target string, libraries array<string>, static_libraries array<string>, "
    "uses_libraries_required array<string>, uses_libraries_optional array<string>, queries_packages array<string>, "
    "provider_authorities array<string>, content_uri_authorities array<string>, is_input_method boolean, handles_home boolean, "
    "handles_dialer boolean, handles_sms_deliver boolean"
)


def _columns(schema: str) -> list[tuple[str, str]]:
    out, depth, part = [], 0, ""
    for char in schema + ",":
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append((name, kind))
            part = ""
        else:
            part += char
    return out


def _row(schema: str, given: dict, defaults: dict) -> tuple:
    values = []
    for name, kind in _columns(schema):
        if name in given:
            values.append(given[name])
        elif name in defaults:
            values.append(defaults[name])
        elif kind.startswith("array"):
            values.append([])
        elif kind == "boolean":
            values.append(False)
        else:
            values.append(None)
    return tuple(values)


def observations(spark, *rows: dict):
    defaults = {
        "device_key": "pixel:a", "build": "B1", "partition": "system", "device_path": "/system/app/x.apk", "label": "App",
        "observed_at": datetime(2024, 1, 1), "has_code": True,
    }
    return spark.createDataFrame([_row(OBSERVATION, r, defaults) for r in rows], OBSERVATION)


def corpus(spark, *rows: dict):
    defaults = {"devices": ["pixel:a"], "partitions": ["system"], "device_count": 1}
    return spark.createDataFrame([_row(CORPUS, r, defaults) for r in rows], CORPUS)
