"""Parsers that run as a process beside the task: one that prints JSON, one that leaves a Markdown file.

The file to parse is written to a folder of the task's own, which goes with the task. A process gets a time limit, after which it is killed with all that it
started; it dies with the task's worker, too. A failed run is tried again, RETRIES times.

Defined results: a null or empty content is an error; each file has a row, with its Markdown or with what went wrong; output that is no UTF-8 is read with marks in place of
what is not; an empty table gives an empty table.
"""

from __future__ import annotations

import ctypes
import json
import os
import signal
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

TIMEOUT_SECONDS, RETRIES, TOLD = 1800, 1, 2000
#: Linux's prctl option that sends a signal when the parent ends.
PARENT_DEATH = 1


class ParserError(RuntimeError):
    pass


def _die_with_parent() -> None:
    ctypes.CDLL(None).prctl(PARENT_DEATH, signal.SIGKILL)


def run_process(command: Sequence[str], seconds: float, cwd: str | None = None, env: dict[str, str] | None = None) -> str:
    """What a process prints on both streams. After `seconds` it is killed, with its own children."""
    child = subprocess.Popen(
        list(command), cwd=cwd, env=os.environ | {"PYTHONIOENCODING": "UTF-8"} | (env or {}), stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, start_new_session=True, preexec_fn=_die_with_parent
    )
    try:
        printed = child.communicate(timeout=seconds)[0].decode(errors="replace")
    except subprocess.TimeoutExpired:
        raise ParserError(f"no end after {seconds:g} seconds") from None
    finally:
        try:
            os.killpg(child.pid, signal.SIGKILL)  # what it started and left behind
        except ProcessLookupError:
            pass
        child.wait()
        child.stdout.close()
    if child.returncode:
        raise ParserError(f"exit code {child.returncode}: {printed[-TOLD:]}")
    return printed


def told_json(printed: str) -> str:
    """The content of the object that begins at the first brace; what stands before it is noise."""
    at = printed.find("{")
    if at < 0:
        raise ParserError(f"no JSON object in the output: {printed[-TOLD:]}")
    try:
        answer = json.JSONDecoder().raw_decode(printed[at:])[0]
    except ValueError as e:
        raise ParserError(f"broken JSON: {e}") from None
    if answer.get("status") != "success":
        raise ParserError(f"the parser says: {answer.get('message')}")
    return answer.get("content") or ""


def fresh_markdown(folder: Path, stem: str, since: float) -> Path:
    """The Markdown file below folder that was written since: that of the file's own name first, then the newest."""
    found = [(p.stem == stem, p.stat().st_mtime, p) for p in folder.rglob("*.md")]
    new = [x for x in found if x[1] >= since - 1]
    if not new:
        raise ParserError(f"no Markdown file was written{' now' if found else ''}")
    return max(new, key=lambda x: x[:2])[2]


def json_script(command: Sequence[str], seconds: float = TIMEOUT_SECONDS) -> Callable[[Path], str]:
    """A parser that is given the file and prints {"status": "success", "content": Markdown}."""
    return lambda path: told_json(run_process([*command, str(path)], seconds))


def markdown_process(command: Sequence[str], seconds: float = TIMEOUT_SECONDS, threads: int = 1) -> Callable[[Path], str]:
    """A parser that is given the file and `-o` a folder, and writes a Markdown file there."""

    def parse(path: Path) -> str:
        out = path.parent / "out"
        out.mkdir(exist_ok=True)
        began = time.time()
        run_process([*command, str(path), "-o", str(out)], seconds, env={"OMP_NUM_THREADS": str(threads)})
        return fresh_markdown(out, path.stem, began).read_text(encoding="utf-8", errors="replace")

    return parse


def attempt(parse: Callable[[Path], str], path: str, content: bytes | None, retries: int = RETRIES) -> tuple[str | None, str | None]:
    """(Markdown, None) or (None, what went wrong in the last run)."""
    if not content:
        return None, "an empty file"
    why = ""
    for _ in range(retries + 1):
        with tempfile.TemporaryDirectory(prefix="parse-") as folder:
            file = Path(folder, Path(path).name or "file")
            file.write_bytes(content)
            try:
                return parse(file), None
            except (ParserError, OSError) as e:
                why = str(e)
    return None, why


def parse_files(files: DataFrame, parse: Callable[[Path], str], retries: int = RETRIES) -> DataFrame:
    """path, markdown, error for files (path, content). One process a task at a time: Spark's tasks are the pool."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(path, *attempt(parse, path, content, retries)) for path, content in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, markdown string, error string")


def parser(parse: Callable[[Path], str], retries: int = RETRIES) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The same for readers.register_parser: a file that cannot be parsed ends the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                markdown, why = attempt(parse, path, content, retries)
                if why is not None:
                    raise ParserError(f"{path}: {why}")
                out.append((path, markdown))
            yield pd.DataFrame(out, columns=["path", "markdown"])

    return run
