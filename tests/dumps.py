"""Small generated inputs."""

from __future__ import annotations

import pathlib


def thread(name, n, state="RUNNABLE", frames=("com.shop.Main.run",), cpu=None, elapsed=None, locks=None,
           cond="waiting on condition", daemon=False, sync=None, nid=None, tid=None, java_id=True):
    """Lines of one thread; locks = {frame index: [lock line text]}, sync = list of addresses or None."""
    attrs = (f'#{n} ' if java_id else "") + ("daemon " if daemon else "") + "prio=5 os_prio=0 "
    if cpu is not None:
        attrs += f"cpu={cpu:.2f}ms elapsed={elapsed if elapsed is not None else 1:.2f}s "
    attrs += f"tid={tid or f'0x{4096 + n:016x}'} nid={nid or hex(100 + n)} {cond} [0x00007f00]"
    out = [f'"{name}" {attrs}']
    if frames or state:
        out.append(f"   java.lang.Thread.State: {state}")
    for i, f in enumerate(frames):
        loc = "Native Method" if f.endswith("0") else "X.java:1"
        out.append(f"\tat {f}({loc})")
        for lock in (locks or {}).get(i, []):
            out.append(f"\t- {lock}")
    out.append("")
    if sync is not None:
        out.append("   Locked ownable synchronizers:")
        out += [f"\t- <{a}> (a java.util.concurrent.locks.ReentrantLock$NonfairSync)" for a in sync] or ["\t- None"]
        out.append("")
    return out


def dump(ts, threads, banner="Full thread dump OpenJDK 64-Bit Server VM (17)", tail=("JNI global refs: 12", "")):
    out = [ts] if ts else []
    if banner:
        out += [banner, ""]
    for t in threads:
        out += t
    return out + list(tail)


def write(folder, name, lines):
    p = pathlib.Path(folder) / name
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def line_table(spark, lines, file="f.log", series="series", chunk_rows=10**9):
    rows = [(series, None, file, file, i // chunk_rows, i, s) for i, s in enumerate(lines)]
    return spark.createDataFrame(
        rows, "series_id string, node string, file string, source_name string, chunk bigint, pos bigint, line string")
