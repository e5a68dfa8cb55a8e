"""Multi-step jobs: profiling, detection, risk, fidelity, fabrication, repair, knowledge."""
