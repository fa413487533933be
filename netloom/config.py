"""Tuning parameters as frozen dataclasses.

Defaults are the reference values. ``load_tuning`` overlays a YAML file with
the same section names; it runs on the driver and reads configuration only.
"""

from __future__ import annotations

import dataclasses as dc
from datetime import date, datetime

MB = 1024 * 1024


@dc.dataclass(frozen=True)
class GlobalConfig:
    learning_period_days: int = 30
    deployment_date: str = "2026-03-01"


@dc.dataclass(frozen=True)
class SemiTrustedConfig:
    suppress_max_bytes: int = 10 * MB
    exfil_always_alert_bytes: int = 50 * MB
    exfil_demoted_severity: str = "medium"
    beaconing_safe_ports: tuple[int, ...] = (443, 80)
    # fixed values
    standard_protocols: tuple[str, ...] = (
        "TCP", "UDP", "TLSv1.2", "TLSv1.3", "QUIC", "HTTP", "HTTPS", "DNS",
    )


@dc.dataclass(frozen=True)
class BeaconConfig:
    min_connections: int = 20
    cv_threshold: float = 0.20
    cv_floor_for_trusted: float = 0.05
    always_suppress_destinations: tuple[str, ...] = ("127.0.0.53", "127.0.0.1", "::1")
    suppress_whitelisted: bool = True


@dc.dataclass(frozen=True)
class ExfilConfig:
    threshold_medium_bytes: int = 200 * MB
    threshold_high_bytes: int = 500 * MB
    suppress_whitelisted: bool = True


@dc.dataclass(frozen=True)
class NewDestinationConfig:
    learning_period_severity: str = "info"
    post_learning_https_only_suppress: bool = True
    suppress_whitelisted: bool = True


@dc.dataclass(frozen=True)
class AnomalyConfig:
    multiplier: float = 5.0
    min_absolute_bytes: int = 10 * MB
    suppress_whitelisted: bool = True
    min_observations: int = 2
    min_average_bytes: float = 1024.0


@dc.dataclass(frozen=True)
class Tuning:
    general: GlobalConfig = GlobalConfig()
    semi_trusted: SemiTrustedConfig = SemiTrustedConfig()
    beaconing: BeaconConfig = BeaconConfig()
    data_exfil: ExfilConfig = ExfilConfig()
    new_dest: NewDestinationConfig = NewDestinationConfig()
    traffic_anomaly: AnomalyConfig = AnomalyConfig()

    def learning(self, as_of: date | datetime | str) -> bool:
        """Still inside the learning period at ``as_of``?

        A missing or unreadable deployment date counts as still learning.
        """
        try:
            deployed = datetime.fromisoformat(self.general.deployment_date)
        except (TypeError, ValueError):
            return True
        if isinstance(as_of, str):
            as_of = datetime.fromisoformat(as_of)
        elif not isinstance(as_of, datetime):
            as_of = datetime(as_of.year, as_of.month, as_of.day)
        return (as_of - deployed).days < self.general.learning_period_days


def _overlay(section, values: dict):
    known = {f.name for f in dc.fields(section)}
    changed = {
        name: tuple(value) if isinstance(value, list) else value
        for name, value in (values or {}).items()
        if name in known
    }
    return dc.replace(section, **changed)


def tuning_from_dict(data: dict) -> Tuning:
    base = Tuning()
    return Tuning(
        general=_overlay(base.general, data.get("global")),
        semi_trusted=_overlay(base.semi_trusted, data.get("semi_trusted")),
        beaconing=_overlay(base.beaconing, data.get("beaconing")),
        data_exfil=_overlay(base.data_exfil, data.get("data_exfil")),
        new_dest=_overlay(base.new_dest, data.get("new_dest")),
        traffic_anomaly=_overlay(base.traffic_anomaly, data.get("traffic_anomaly")),
    )


def read_yaml(path: str) -> dict:
    """A YAML mapping from ``path``; empty when missing or unreadable."""
    try:
        import yaml

        with open(path, encoding="utf-8") as handle:
            data = yaml.safe_load(handle)
    except Exception:
        return {}
    return data if isinstance(data, dict) else {}


def load_tuning(path: str) -> Tuning:
    return tuning_from_dict(read_yaml(path))
