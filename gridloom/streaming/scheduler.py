"""The loop that runs programs whose interval is over."""

from __future__ import annotations

import logging
import threading

from gridloom.plans.service import AnalyticsService

log = logging.getLogger(__name__)
#: Seconds between two looks at what is due.
POLL = 10.0


class Scheduler:
    """A thread that calls the service's tick; an error in one look doesn't end it."""

    def __init__(self, service: AnalyticsService, poll: float = POLL):
        self.service, self.poll = service, poll
        self._over = threading.Event()
        self._thread: threading.Thread | None = None

    def start(self) -> "Scheduler":
        self._thread = threading.Thread(target=self._run, daemon=True, name="gridloom-scheduler")
        self._thread.start()
        return self

    def stop(self) -> None:
        self._over.set()
        if self._thread:
            self._thread.join()

    def _run(self) -> None:
        while not self._over.is_set():
            try:
                self.service.tick()
            except Exception:
                log.exception("looking for due programs failed")
            self._over.wait(self.poll)
