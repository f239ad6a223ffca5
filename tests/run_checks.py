"""Run queries against their checks: python tests/run_checks.py [sf_dir] [name or module ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quillsift.session import local_session  # noqa: E402
from tests.checking import compare, connect  # noqa: E402


def main():
    import __spark_entry__ as spec

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("8")
    con = connect(sf_dir)
    checks = spec.oracle_sql()
    bad = []
    for name, run in spec.queries().items():
        if wanted and name not in wanted and run.__module__.rsplit(".", 1)[-1] not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            note = compare(df, con, checks[name]) if name in checks else f"{len(df.collect())} rows, no check"
        except Exception as error:  # noqa: BLE001
            note = f"{type(error).__name__}: {str(error)[:1500]}"
        ok = note is None
        if not ok and not (note or "").endswith("no check"):
            bad.append(name)
        print(f"{'ok' if ok else note} <- {name} {time.time() - start:.1f}s", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
