"""Running the external classifier on the driver; it needs its program and database installed."""

from __future__ import annotations

import os
import shutil
import subprocess


def kraken2(
    reads: str | list[str], *options: str, db: str | None = None, kreport: str = "kraken_report.txt", koutput: str = "kraken_output.txt", classified_out: str = "classified.fq",
    unclassified_out: str | None = None, program: str | None = None, envpath: str | None = None, conda: str | None = None, condaroot: str | None = None, threads: int | None = None, odir: str = ".", run: bool = True,
) -> list[str]:
    """The command that was run, or would be with run=False. Pairs need a "#" in the names of read outputs."""
    reads = [reads] if isinstance(reads, str) else list(reads)
    if not 1 <= len(reads) <= 2:
        raise ValueError("`reads` is one file or two")
    for name, v in (("kreport", kreport), ("koutput", koutput), ("classified_out", classified_out)):
        if not v:
            raise ValueError(f"`{name}` must not be empty")
    threads = threads or os.cpu_count() or 1
    at = lambda p: os.path.join(odir, p)
    command = [program or shutil.which("kraken2", path=envpath) or "kraken2", "--threads", str(threads), "--report", at(kreport), "--output", at(koutput), "--classified-out", at(classified_out)]
    command += ["--db", db] if db else []
    command += ["--unclassified-out", at(unclassified_out)] if unclassified_out else []
    command += ["--paired"] if len(reads) == 2 else []
    command += [*options, *reads]
    if conda:
        command = [os.path.join(condaroot, "bin", "conda") if condaroot else "conda", "run", "-n", conda, *command]
    if run:
        os.makedirs(odir, exist_ok=True)
        subprocess.run(command, check=True)
    return command
