"""The JSON Schema of a record."""

from __future__ import annotations

from granary.plans.coherence import ALLOWED, CONFIDENCES, ERROR_KINDS, FAMILIES, LAYERS, PARTIAL_REASONS, POSTURES, SEVERITIES

_TEXT, _MAYBE, _COUNT, _FLAG = {"type": "string"}, {"type": ["string", "null"]}, {"type": "integer", "minimum": 0}, {"type": "boolean"}


def _list(items: dict) -> dict:
    return {"type": "array", "items": items}


def _of(values) -> dict:
    return {"enum": sorted(values)}


def _record(**properties: dict) -> dict:
    """Every key is always there; nothing else is."""
    return {"type": "object", "properties": properties, "required": sorted(properties), "additionalProperties": False}


def _or_null(x: dict) -> dict:
    return {"anyOf": [x, {"type": "null"}]}


def record_schema(precedence: list[str]) -> dict:
    classes, relations, families = {"enum": list(precedence)}, _of(ALLOWED), _of(FAMILIES)
    place = _record(path=_TEXT, line=_or_null({"type": "integer", "minimum": 1}), evidence=_TEXT)
    finding = _record(
        rule_id=_TEXT, subject=_MAYBE, subject_kind=_TEXT, severity=_of(SEVERITIES), category=_TEXT, layer=_of(LAYERS), confidence=_of(CONFIDENCES), verdict=_or_null(classes), relation=_or_null(relations),
        basis=_list(_TEXT), family=_or_null(families), needs_human_review=_FLAG, occurrences=_COUNT, truncated=_FLAG, locations=_list(place),
    )
    go = _record(go_version=_MAYBE, boring_crypto=_FLAG, markers=_list(_TEXT))
    binary = _record(
        path=_TEXT, format=_of({"elf", "macho", "pe", "ar", "unknown"}), vendored_path=_FLAG, machine=_MAYBE, bits={"enum": [32, 64, None]}, endian={"enum": ["little", "big", None]}, elf_type=_MAYBE, soname=_MAYBE,
        needed=_list(_TEXT), rpath=_list(_TEXT), runpath=_list(_TEXT), stripped={"type": ["boolean", "null"]}, symbol_counts=_record(dynsym=_COUNT, symtab=_COUNT),
        matched_symbols=_list(_record(group=_TEXT, name=_TEXT, binding=_of({"imported", "defined"}))), matched_strings=_list(_record(group=_TEXT, value=_TEXT)), rust_crates=_list(_record(name=_TEXT, version=_MAYBE)),
        go=_or_null(go), truncated=_record(symbols=_FLAG, strings=_FLAG), partial_analysis=_FLAG, partial_reasons=_list(_of(PARTIAL_REASONS)),
    )
    wheel = _record(
        filename=_TEXT, sha256={"type": "string", "pattern": "^[0-9a-f]{64}$"}, size_bytes=_COUNT, generator=_or_null(_record(name=_MAYBE, version=_MAYBE, raw=_TEXT)), name=_MAYBE, canonical_name=_MAYBE, version=_MAYBE,
        tags=_list(_TEXT), platform_tags=_list(_TEXT), requires_python=_MAYBE, requires_dist=_list(_TEXT), root_is_purelib={"type": ["boolean", "null"]},
    )
    artifacts = _record(
        py_files=_COUNT, pyc_files=_COUNT, py_files_unparsed=_COUNT, source_available=_FLAG, total_uncompressed_bytes=_COUNT, binaries_truncated=_FLAG, record_entries=_COUNT,
        extensions=_list(_record(path=_TEXT, format=_TEXT)), bundled_libs=_list(_TEXT), sboms=_list(_TEXT), skipped=_list(_record(path=_TEXT, reason=_of(ERROR_KINDS))), skipped_truncated=_FLAG,
        symlinks=_list(_record(path=_TEXT, target=_TEXT)), symlinks_truncated=_FLAG,
    )
    verdict = _record(**{"class": classes}, classes=_list(classes), relations=_list(relations), rule_ids=_list(_TEXT), reasons=_list(_TEXT), needs_human_review=_FLAG, conditions={"type": "object", "additionalProperties": _of(POSTURES)})
    error = _record(stage=_of({"archive", "metadata", "binary", "python"}), kind=_of(ERROR_KINDS), path=_MAYBE, message=_TEXT)
    whole = _record(
        schema_version={"type": "integer"}, tool=_record(name=_TEXT, analyzer_version={"type": "integer"}, ruleset_version=_TEXT, evidence_level=_of({"standard", "minimal"})), wheel=wheel, artifacts=artifacts,
        binaries=_list(binary), findings=_list(finding), verdict=verdict, crypto=_record(families=_list(families), libraries=_list(_record(name=_TEXT, linkage=_of(POSTURES)))), errors=_list(error), errors_truncated=_FLAG,
    )
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Cryptography found in one wheel"} | whole


def mismatches(x: object, schema: dict, at: str = "$") -> list[str]:
    """Where a value departs from a schema of the kinds used here; empty if it fits."""
    if "anyOf" in schema:
        tried = [mismatches(x, s, at) for s in schema["anyOf"]]
        return [] if any(not t for t in tried) else tried[0]
    if "enum" in schema:
        return [] if x in schema["enum"] else [f"{at}: {x!r}"]
    kinds = {"string": str, "integer": int, "boolean": bool, "array": list, "object": dict, "null": type(None)}
    wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    if not any(isinstance(x, kinds[k]) and not (k == "integer" and isinstance(x, bool)) for k in wanted):
        return [f"{at}: {type(x).__name__} in place of {wanted}"]
    if isinstance(x, list):
        return [m for i, v in enumerate(x) for m in mismatches(v, schema["items"], f"{at}[{i}]")]
    if not isinstance(x, dict):
        return [f"{at}: {x}"] if isinstance(x, int) and x < schema.get("minimum", x) else []
    own, more = schema.get("properties", {}), schema.get("additionalProperties", False)
    out = [f"{at}.{k} is missing" for k in schema.get("required", ()) if k not in x]
    for k, v in x.items():
        if k in own or more:
            out += mismatches(v, own.get(k, more), f"{at}.{k}")
        else:
            out.append(f"{at}.{k} is unknown")
    return out
