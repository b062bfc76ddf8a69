"""Settings of the event-time operators. Times are in the unit of the observation stream."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    sample_rate: float = 2.0
    gate_signal: float = 4.2
    gate_keepalive: float = 4.0
    gap: float = 1.0
    floor_step: float = 20.0
    floor_least: float = 60.0
    frames_per_window: int = 4
    top_rules: int = 5
    health_percentile: float = 0.12
    enter_confidence: float = 0.55
    health_threshold: float = -0.4
    loose_factor: float = 0.4
    extent_buffer: float = 2.0
    probe_span: float = 16.0
    probe_step: float = 4.0
    probe_frames: int = 8
    override_at: float = 0.90
    crop_context: float = 3.0
    crop_least: float = 320.0


#: The same operators bound to a stream in hours with values in place of motion.
BOUND = Config(gate_signal=60.0, gate_keepalive=24.0, gap=12.0, floor_step=120.0, floor_least=360.0, probe_span=96.0, probe_step=24.0)
