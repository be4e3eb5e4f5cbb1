"""Recurring runs as crontab lines, or as tasks of Windows. Cron counts minutes, hours and days apart,
so an interval must divide the next larger unit."""

from __future__ import annotations

import shlex
import subprocess

#: Minutes of an hour and of a day, and what may recur.
HOUR, DAY = 60, 1440
RECURRING = ("import", "import-api", "export")


class ScheduleError(ValueError):
    """An interval or command that can't recur."""


def cron_fields(minutes: int) -> str:
    units = ((1, HOUR, "*/{} * * * *"), (HOUR, DAY, "0 */{} * * *"), (DAY, None, "0 0 */{} * *"))
    for unit, above, shape in units:
        if above is None or minutes < above:
            if minutes <= 0 or minutes % unit or (above and above % minutes):
                raise ScheduleError(f"{minutes} minutes don't divide an hour, a day, or into whole days")
            return shape.format(minutes // unit)
    raise AssertionError


def marker(name: str) -> str:
    return f"# postloom-job:{name}"


def allowed(command: list[str]) -> list[str]:
    if not command or command[0] not in RECURRING:
        raise ScheduleError(f"only {', '.join(RECURRING)} can recur")
    return command


def cron_line(name: str, minutes: int, python: str, folder: str, log: str, command: list[str]) -> str:
    run = shlex.join([python, "-m", "postloom.cli", *allowed(command)])
    return f"{cron_fields(minutes)} cd {shlex.quote(folder)} && {run} >> {shlex.quote(log)} 2>&1 {marker(name)}"


def without(lines: list[str], name: str) -> list[str]:
    """A crontab without a job: its lines end in the job's marker."""
    return [x for x in lines if not x.rstrip().endswith(marker(name))]


def jobs(lines: list[str]) -> list[str]:
    head = marker("")
    return [x.rpartition(head)[2].strip() for x in lines if head in x]


TASKS = "\\postloom\\"


def windows_task(name: str, minutes: int, python: str, command: list[str]) -> list[str]:
    """The words that make a task of Windows which recurs; a task of that name is replaced."""
    if minutes <= 0:
        raise ScheduleError(f"{minutes} minutes can't recur")
    every = ["MINUTE", str(minutes)] if minutes < DAY else ["DAILY", str(minutes // DAY)]
    if minutes > DAY and minutes % DAY:
        raise ScheduleError(f"{minutes} minutes aren't whole days")
    run = subprocess.list2cmdline([python, "-m", "postloom.cli", *allowed(command)])
    return ["schtasks", "/Create", "/F", "/TN", TASKS + name, "/SC", every[0], "/MO", every[1], "/TR", run]


def windows_without(name: str) -> list[str]:
    return ["schtasks", "/Delete", "/F", "/TN", TASKS + name]
