"""Checks by external tools where a worker has them: bounded processes a task, time limits, kill by process id.

What the tools say decides; a tool that is absent leaves the result of the parser or of the bracket check, a JavaScript or TypeScript
result then being heuristic and not verified. Nothing that is checked is executed.
"""

from __future__ import annotations

import os
import shutil
import signal
import subprocess
import tempfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.verify import LANGUAGE_TAGS, RESULT, verify_one

# Tools of a language in the order in which they are tried, with what they are asked. A tool in REFUSES counts as
# verified also where it finds a fault; one in NEEDS is only asked where the other is there, too.
TOOLS = {
    "py": (("mypy", ("--ignore-missing-imports", "--no-error-summary")),),
    "js": (("eslint", ("--no-eslintrc", "--env", "es2022")), ("node", ("--check",))),
    "ts": (("tsc", ("--noEmit", "--target", "ES2022", "--skipLibCheck")),),
}
REFUSES = ("mypy",)
NEEDS = {"eslint": "node"}
SHOWN = {"node": "node --check"}

Result = tuple[bool, bool, bool, str | None, str]


def finished(command: list[str], timeout: float) -> tuple[int, str] | None:
    """(exit code, output) of a process in a session of its own; None after the time limit, when all of the session is killed."""
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, stdin=subprocess.DEVNULL, text=True, errors="replace", start_new_session=True) as p:
        try:
            out, err = p.communicate(timeout=timeout)
        except subprocess.TimeoutExpired:
            os.killpg(p.pid, signal.SIGKILL)
            p.communicate()
            return None
    return p.returncode, f"{out}\n{err}".strip()


@dataclass
class Checkers:
    """The tools on ``path`` (by default the worker's), how long one may take, and how many run at once."""

    timeout: float = 10
    at_once: int = 2
    path: str | None = None

    def one(self, code: str | None, language: str) -> Result:
        """(valid, verified, heuristic, error, checker) of a snippet."""
        plain = verify_one(code, language)
        if not plain[0]:
            return plain
        for name, options in TOOLS[language]:
            tool = shutil.which(name, path=self.path)
            if tool and (name not in NEEDS or shutil.which(NEEDS[name], path=self.path)):
                found = self._asked(name, [tool, *options], code, language)
                if found:
                    return found
        return plain

    def _asked(self, name: str, command: list[str], code: str, language: str) -> Result | None:
        """A tool's word; None where it cannot be started, so that the next one is asked."""
        with tempfile.TemporaryDirectory() as folder:
            file = f"{folder}/verification.{language}"
            with open(file, "w", encoding="utf-8", errors="replace") as f:
                f.write(code)
            try:
                done = finished([*command, file], self.timeout)
            except OSError as e:
                return None if name in (*REFUSES, *NEEDS) else (False, False, False, str(e), name)
        if done is None:
            return False, name in REFUSES, False, f"{SHOWN.get(name, name)} timed out after {self.timeout:g}s", name
        status, said = done
        return (True, True, False, None, name) if status == 0 else (False, name in REFUSES, False, said, name)

    def all(self, snippets: list[tuple[str | None, str | None]]) -> list[Result]:
        def run(snippet: tuple[str | None, str | None]) -> Result:
            code, given = snippet
            tag = LANGUAGE_TAGS.get((given or "").strip().lower())
            return self.one(code, tag) if tag else (False, False, False, f"Unsupported language: {given!r}", "none")

        with ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(run, snippets))


def verify_with_tools(code: Column | str, language: Column | str, timeout: float = 10, at_once: int = 2, path: str | None = None) -> Column:
    """The result struct of :func:`heddle.functions.verify.verify_code`, with the external tools that a worker has."""
    checkers = Checkers(timeout, at_once, path)

    @F.pandas_udf(RESULT)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for codes, languages in parts:
            yield pd.DataFrame(checkers.all(list(zip(codes, languages, strict=True))), columns=RESULT.names)

    return run(code, language)
