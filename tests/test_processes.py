"""Parser processes: time limits, stale output, noise, retries, and what a killed worker leaves."""

import os
import signal
import subprocess
import sys
import time

import pytest

from marginalia.sources import processes, readers

SCRIPTS = {
    "hangs": "import subprocess, sys, time\nsubprocess.Popen([sys.executable, '-c', 'import time; time.sleep(300)'])\ntime.sleep(300)",
    "noise": "import sys\nprint('warning: a model was loaded')\nprint('{\"status\": \"success\", \"content\": \"# ' + open(sys.argv[1]).read() + '\"}')\nprint('bye {')",
    "refuses": "print('{\"status\": \"error\", \"message\": \"no pages\"}')", "silent": "print('nothing')", "fails": "import sys\nprint('out of memory')\nsys.exit(3)",
    "writes": "import sys, pathlib\no = pathlib.Path(sys.argv[3], 'deep'); o.mkdir()\n(o / 'other.md').write_text('other')\n(o / (pathlib.Path(sys.argv[1]).stem + '.md')).write_text('# é', encoding='utf-8')",
    "old": "import sys, os, pathlib\np = pathlib.Path(sys.argv[3], 'x.md'); p.write_text('old'); os.utime(p, (1, 1))", "none": "pass",
}


@pytest.fixture
def script(tmp_path):
    def make(name):
        path = tmp_path / f"{name}.py"
        path.write_text(SCRIPTS[name])
        return [sys.executable, str(path)]

    return make


def test_json_scripts(spark, script):
    files = spark.createDataFrame([("/a/one.pdf", b"one"), ("/a/two.pdf", b"two"), ("/a/empty.pdf", b""), ("/a/null.pdf", None)], "path string, content binary")
    got = {r.path: (r.markdown, r.error) for r in processes.parse_files(files, processes.json_script(script("noise"))).collect()}
    assert got == {"/a/one.pdf": ("# one", None), "/a/two.pdf": ("# two", None), "/a/empty.pdf": (None, "an empty file"), "/a/null.pdf": (None, "an empty file")}
    for name, why in {"refuses": "no pages", "silent": "no JSON object", "fails": "exit code 3: out of memory"}.items():
        assert why in processes.attempt(processes.json_script(script(name)), "x.pdf", b"x")[1]
    readers.register_parser("Script", processes.parser(processes.json_script(script("noise"))))
    assert {r.markdown for r in readers.parse_files(files.limit(2), " SCRIPT ").collect()} == {"# one", "# two"}


def test_markdown_processes(script):
    assert processes.attempt(processes.markdown_process(script("writes")), "/in/doc.pdf", b"x") == ("# é", None)
    assert "written now" in processes.attempt(processes.markdown_process(script("old")), "doc.pdf", b"x")[1]
    assert processes.attempt(processes.markdown_process(script("none")), "doc.pdf", b"x")[1] == "no Markdown file was written"


def alive(mark):
    told = subprocess.run(["ps", "-eo", "pid,ppid,stat,args"], capture_output=True, text=True).stdout.splitlines()
    return [x for x in told if mark in x and " Z" not in x and "ps -eo" not in x]


def test_a_process_that_hangs_is_killed_with_its_children(script):
    began = time.time()
    assert processes.attempt(processes.json_script(script("hangs"), seconds=1.5), "x.pdf", b"x", retries=0)[1] == "no end after 1.5 seconds"
    assert time.time() - began < 20
    time.sleep(0.5)
    assert not alive("hangs.py") and not alive("time.sleep(300)")


def test_a_run_is_tried_again():
    runs = []

    def parse(path):
        runs.append(path.read_bytes())
        if len(runs) == 1:
            raise processes.ParserError("once")
        return "done"

    assert processes.attempt(parse, "x.pdf", b"x") == ("done", None) and runs == [b"x", b"x"]
    assert processes.attempt(lambda _: processes.told_json("{"), "x.pdf", b"x")[1].startswith("broken JSON")


def test_a_killed_worker_leaves_no_process(script, tmp_path):
    code = f"from marginalia.sources import processes\nprocesses.run_process({script('hangs')!r}, 60)"
    worker = subprocess.Popen([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": os.getcwd()})
    until = time.time() + 30
    while not alive("hangs.py'") and not [x for x in alive("hangs.py") if "-c" not in x] and time.time() < until:
        time.sleep(0.2)
    worker.send_signal(signal.SIGKILL)
    worker.wait()
    time.sleep(1)
    assert not [x for x in alive("hangs.py") if "-c" not in x]
    for line in alive("time.sleep(300)"):  # what the script had started itself
        os.kill(int(line.split()[0]), signal.SIGKILL)
