"""Engine state of a fix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and names of the engine states.
OFF, STATIONARY, MOVING = 1, 2, 3
STATE_NAMES = {1: "ENGINE_OFF", 2: "ENGINE_ON_STATIONARY", 3: "ENGINE_MOVING"}


def engine_state(power_on: Column, speed: Column) -> Column:
    return F.when(~power_on, OFF).when(speed == 0, STATIONARY).otherwise(MOVING)


def state_name(state: Column) -> Column:
    named = F
    for code, name in STATE_NAMES.items():
        named = named.when(state == code, name)
    return named


def is_idle(power_on: Column, speed: Column) -> Column:
    return power_on & (speed == 0)
