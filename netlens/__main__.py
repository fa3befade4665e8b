"""``python -m netlens ingest|report ...``: the batch jobs (see ``netlens.jobs``)."""

from .jobs import main

main()
