"""python -m scriptloom [FILE] [-o FOLDER [-f]]: one program, from a file or standard input, without Spark."""

from __future__ import annotations

import argparse
import os
import sys

from scriptloom.js.pipeline import Options, rewrite
from scriptloom.sources.sinks import save_bundle_files


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scriptloom", description="Makes JavaScript readable and takes bundles apart.")
    p.add_argument("file", nargs="?", help="the program; standard input if left out")
    p.add_argument("-o", "--output", help="a folder for the program and its bundle's modules")
    p.add_argument("-f", "--force", action="store_true", help="write into a folder that exists")
    p.add_argument("-m", "--mangle", action="store_true", help="give variables names by role")
    for stage in ("jsx", "unpack", "deobfuscate", "unminify"):
        p.add_argument(f"--no-{stage}", action="store_false", dest=stage, help=f"leave out {stage}")
    a = p.parse_args(args)
    if a.output and os.path.exists(a.output) and not a.force:
        print(f"{a.output} exists; -f writes into it", file=sys.stderr)
        return 1
    if a.file:
        with open(a.file, encoding="utf-8") as f:
            code = f.read()
    else:
        code = sys.stdin.read()
    r = rewrite(code, Options(jsx=a.jsx, unpack=a.unpack, deobfuscate=a.deobfuscate, unminify=a.unminify, mangle=a.mangle))
    if not a.output:
        print(r.code)
        return 0
    if r.bundle:
        save_bundle_files(r.bundle, a.output)
    os.makedirs(a.output, exist_ok=True)
    with open(os.path.join(a.output, "deobfuscated.js"), "w", encoding="utf-8") as f:
        f.write(r.code)
    return 0


if __name__ == "__main__":
    sys.exit(main())
