"""Requests as JSON that keeps its bytes: order of keys and spelling of numbers stay, only texts that were changed differ."""

from __future__ import annotations

import json
import re

_MARK = "\ue000"
_NUMBER = re.compile(f'"{_MARK}([^"]*)"')


def _refuse(name: str) -> None:
    raise ValueError(name)


def parse(payload: str) -> object:
    """The request; numbers are strings with a mark before them, so that they are written as they were. ValueError if it is not JSON."""
    if _MARK in payload or "\\ue000" in payload.lower():  # the mark occurs in a text: numbers are read as numbers
        return json.loads(payload, parse_constant=_refuse)
    keep = lambda s: _MARK + s
    return json.loads(payload, parse_float=keep, parse_int=keep, parse_constant=_refuse)


def compact(body: object) -> str:
    """JSON without blanks, keys in their order."""
    return _NUMBER.sub(r"\1", json.dumps(body, ensure_ascii=False, separators=(",", ":")))


def put(api: str, body: dict, message: int, part: int, text: str) -> None:
    """Put a text in its place; a result that was a list becomes one text part."""
    item = body["input" if api == "openai-responses" else "messages"][message]
    if api == "openai-responses" and item.get("type") == "function_call_output":
        item["output"] = text
    elif isinstance(item.get("content"), str):
        item["content"] = text
    elif item["content"][part].get("type") == "tool_result":
        own = item["content"][part]
        own["content"] = [{"type": "text", "text": text}] if isinstance(own.get("content"), list) else text
    else:
        item["content"][part]["text"] = text


def rewrite(api: str, payload: str, changes: list[tuple[int, int, str]]) -> str:
    """The request with each text at its (message, part); without changes it is given back byte for byte."""
    if not changes:
        return payload
    body = parse(payload)
    for message, part, text in changes:
        put(api, body, message, part, text)
    return compact(body)
