import re

import pytest

from quillstream.llm import memory


def held() -> int:
    """Megabytes of this process's own memory."""
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read()).group(1)) // 1024


@pytest.mark.parametrize("fails", [False, True])
def test_free_memory_is_given_back_when_a_task_ends(fails):
    # before, an idle process kept what its last task had freed below anything still in use
    pins = []

    def run(batches):
        for n in batches:
            parts = [bytearray(60_000) for _ in range(n)]
            pins.append(bytearray(60_000))
            yield len(parts)
            del parts
        if fails:
            raise ValueError("lost")

    before = held()
    if fails:
        with pytest.raises(ValueError):
            list(memory.trimmed(run)([3000]))
    else:
        assert list(memory.trimmed(run)([3000])) == [3000]
    assert held() - before < 60
    assert memory.trimmed(lambda table: table + 1)(1) == 2
