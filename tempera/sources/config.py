"""Settings, from a properties file: a session override goes before the file, the file before the
default. Keys of the old process layout are accepted and ignored."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    # The keys and defaults of the property files this engine reads.
    ClusterFile: str = "cluster.txt"
    LabelFile: str = "labels.txt"
    ComparisonClusterFile: str = "ComparisonClusterFile.txt"
    RestartClusterFile: str = "RestartClusterFile.txt"
    TimingFile: str = "timings.txt"
    SummaryFile: str = "summary.txt"
    UseSponge: bool = False
    SpongeFactor1: float = 3.0
    SpongeFactor2: float = 3.0
    SpongePOption: int = 1
    SpongePWeight: float = 0.1
    CreateSpongeScaledSquaredWidth: float = -1.0
    SpongeTemperature1: float = -1.0
    SpongeTemperature2: float = -1.0
    RestartTemperature: float = -1.0
    ParameterVectorDimension: int = 2
    SelectedInputLabel: int = 6
    RestartSelectedInputLabel: int = -100000000
    InputFileType: int = 0
    Replicate: int = 1
    CompareSolution: int = -1
    SigmaMethod: int = 0
    SigmaVectorParameters_i: tuple[float, ...] = (0.000598, 2.35)
    FinalTargetTemperature: float = 3.0
    FinalTargetSigma0: float = 0.0
    InitialSigma0: float = 0.0
    ClusterCountOutput: int = 0
    NumberNearbyClusters: int = 5
    NearbySpongePointLimit: float = -1.0
    MagicTemperatures: tuple[float, ...] = (4.0, 3.0, 2.0, 1.0, 0.5)
    MagicIndex: int = 0
    MaxNcentTotal: int = 0
    maxNcentCreated: int = 0
    TargetNcentPerPoint: int = 20
    MaxNcentPerPoint: int = 25
    ExpArgumentCut1: float = 20.0
    ExpArgumentCut2: float = 40.0
    ExpArgumentCut3: float = 50.0
    Tminimum: float = -1000.0
    InitialNcent: int = 1
    MinimumCountForClusterCk: float = 1.0
    MinimumCountForClusterCkWithSponge: float = 1.5
    MinimuCountForClusterPoints: int = 2
    CountForClusterCkToBeZero: float = 0.001
    InitialCoolingFactor1: float = 0.9875
    InitialCoolingFactor2: float = 0.99375
    FineCoolingFactor1: float = 0.9975
    FineCoolingFactor2: float = 0.999375
    CoolingTemperatureSwitch: float = 12.0
    WaitIterations: int = 10
    WaitIterationsConverge: int = 4
    IterationAtEnd: int = 2000
    ConvergenceLoopLimit: int = 20
    FreezingLimit: float = 0.002
    MalphaMaxChange: float = 0.005
    MalphaMaxChange1: float = 0.005
    MaxNumberSplitClusters: int = 3
    TooSmallToSplit: float = 4.0
    MinimumScaledWidthSquaredToSplit: float = 1.5
    ScaledSquaredDistanceAtClosenessTest: float = 0.5
    ClusterLimitForDistribution: int = -1
    TemperatureLimitForDistribution: float = -1.0
    TemperatureForClosenessTest: float = 4.0
    LCMSmode: int = 1
    HistogramOccupationMax: int = 202
    HistogramDistancesMax: int = 200

    @classmethod
    def from_properties(cls, text: str, overrides: dict[str, str] | None = None) -> Config:
        found: dict[str, str] = {}
        for line in text.splitlines():
            line = line.strip()
            if line and line[0] not in "#!":
                key, _, value = line.replace(":", "=", 1).partition("=") if "=" not in line else line.partition("=")
                found[key.strip()] = value.strip()
        found |= overrides or {}
        out = {}
        for f in fields(cls):
            if f.name in found:
                v = found[f.name]
                if isinstance(f.default, bool):
                    out[f.name] = v.lower() == "true"
                elif isinstance(f.default, tuple):
                    out[f.name] = tuple(float(x) for x in v.split(","))
                else:
                    out[f.name] = type(f.default)(v)
        return cls(**out).checked()

    def checked(self) -> Config:
        """The bounds that the settings have among themselves."""
        return replace(
            self,
            MaxNcentPerPoint=max(self.MaxNcentPerPoint, self.TargetNcentPerPoint + self.MaxNumberSplitClusters + 3),
            InitialCoolingFactor2=max(self.InitialCoolingFactor1, self.InitialCoolingFactor2),
            FineCoolingFactor2=max(self.FineCoolingFactor1, self.FineCoolingFactor2),
        )


def command_line(argv: list[str]) -> argparse.Namespace:
    """``-c file -n nodes -t threads``, all needed; nodes times threads is a hint for partitions. ``--set Key=value``, as often as
    needed, goes before the file."""
    p = argparse.ArgumentParser()
    for short, long, kind in (("-c", "--configFile", str), ("-n", "--nodeCount", int), ("-t", "--threadCount", int)):
        p.add_argument(short, long, type=kind, required=True)
    p.add_argument("--set", action="append", default=[], metavar="Key=value")
    return p.parse_args(argv)
