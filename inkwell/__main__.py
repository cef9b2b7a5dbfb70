"""python -m inkwell list PATH | snapshot PATH [EPOCH]: what a stored index holds."""

from __future__ import annotations

import json
import sys

from .session import local_session
from .sources.store import describe_snapshot, list_snapshots


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("list", "snapshot"):
        print(__doc__)
        return 2
    spark = local_session(2, memory="1g")
    if args[0] == "list":
        for epoch in list_snapshots(spark, args[1]):
            print(epoch)
    else:
        print(json.dumps(describe_snapshot(spark, args[1], int(args[2]) if len(args) > 2 else None), indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
