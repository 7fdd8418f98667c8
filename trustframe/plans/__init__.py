"""Multi-stage jobs: training rounds, sweeps, baselines and run analytics."""
